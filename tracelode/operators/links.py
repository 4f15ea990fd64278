"""Links between cases: the master table of indicators, its queries, and the case-indicator graph.

The table has indicator_value, indicator_type, project_name, context and further columns; (value, project, context) is
unique. Everything is joins on the value or the project, so a value that many cases share is a skewed join key, which
adaptive execution splits, and never a group in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import datasets

UNIQUE = ["indicator_value", "project_name", "context"]


def indicator_rows(found: DataFrame, strict: bool = False) -> DataFrame:
    """Findings as the master table stores them; effective: URLs as their domains, position 0; `strict`: each URL and its place."""
    rows = found if strict else datasets.url_domains(found)
    return rows.select(
        F.col("value").alias("indicator_value"), F.col("category").alias("indicator_type"), F.col("case_name").alias("project_name"), F.coalesce("context", F.lit("")).alias("context"),
        F.lit(None if strict else "None").cast("string").alias("timestamp_str"), (F.col("position") if strict else F.lit(0)).cast("int").alias("position"),
        F.lit(1.0).alias("confidence_score"), F.lit(1).alias("is_relevant"),
    )


def insert_or_ignore(table: DataFrame | None, rows: DataFrame) -> DataFrame:
    """The rows to append: not in the table yet, each key once (of the rows with a key, the first by type)."""
    new = rows if table is None else rows.join(table.select(*UNIQUE), UNIQUE, "left_anti")
    rest = [c for c in rows.columns if c not in UNIQUE]
    first = new.groupBy(*UNIQUE).agg(F.min(F.struct(*(["indicator_type"] + [c for c in rest if c != "indicator_type"]))).alias("f"))
    return first.select(*UNIQUE, "f.*").select(*rows.columns)


def project_row(added: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """project_name, status, total_findings (newly added)."""
    return added.groupBy("project_name").agg(F.count("*").alias("total_findings")).withColumn("status", F.lit("completed"))


def direct(indicators: DataFrame, term: str) -> DataFrame:
    """The projects that hold a value."""
    return indicators.where(F.col("indicator_value") == term).select("project_name").distinct()


def linked_indicators(indicators: DataFrame, term: str) -> DataFrame:
    """project_name, indicator_value: what else the projects that hold a value hold."""
    return indicators.join(direct(indicators, term), "project_name", "left_semi").where(F.col("indicator_value") != term).select("project_name", "indicator_value").distinct()


def secondary(indicators: DataFrame, term: str) -> DataFrame:
    """Projects at one remove: case, connected_to, reason; of several reasons the smallest value, then the smallest project.

    Of the linked projects that share a reason only the smallest can be named, so each reason is a row before the join."""
    first = linked_indicators(indicators, term).groupBy(F.col("indicator_value").alias("reason")).agg(F.min("project_name").alias("connected_to"))
    other = indicators.join(direct(indicators, term), "project_name", "left_anti").select(F.col("project_name").alias("case"), "indicator_value").distinct()
    best = other.join(first, F.col("indicator_value") == F.col("reason")).groupBy("case").agg(F.min(F.struct("reason", "connected_to")).alias("b"))
    return best.select("case", "b.connected_to", "b.reason").orderBy("case")


def graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, category, label) and edges (src: case, dst: value, weight) of the linking categories.

    A value in two categories is one node, of the last category by name; every case is a node."""
    strong = found.where(F.col("category").isin(*fixed.LINKING)).select("case_name", "category", "value")
    values = strong.groupBy("value").agg(F.max("category").alias("category")).select(F.col("value").alias("id"), F.lit("indicator").alias("type"), "category", F.col("value").alias("label"))
    cases = found.select("case_name").distinct().select(F.col("case_name").alias("id"), F.lit("case").alias("type"), F.lit(None).cast("string").alias("category"), F.col("case_name").alias("label"))
    edges = strong.select(F.col("case_name").alias("src"), F.col("value").alias("dst")).distinct().withColumn("weight", F.lit(1))
    return cases.unionByName(values), edges


def ego(edges: DataFrame, start: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """The nodes within `depth` steps of a node, with their distance, and the edges among them."""
    both = edges.select("src", "dst").unionAll(edges.select("dst", "src"))
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, steps int")
    front = seen.select("id")
    for step in range(1, depth + 1):
        nxt = both.join(front, both.src == front.id, "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen, front = seen.unionAll(nxt.withColumn("steps", F.lit(step))), nxt
    ids = seen.select("id")
    inner = edges.join(ids, edges.src == ids.id, "left_semi").join(ids, F.col("dst") == ids.id, "left_semi")
    return seen, inner


def bridges(edges: DataFrame, most_listed: int | None = None) -> DataFrame:
    """value, cases (their number) and the listed cases of each value that more than one case holds."""
    d = edges.select("src", "dst").distinct()
    many = d.groupBy("dst").agg(F.count("*").alias("cases")).where("cases > 1")
    listed = F.sort_array(F.collect_list("src"))
    named = d.join(many.select("dst"), "dst", "left_semi").groupBy("dst").agg((listed if most_listed is None else F.slice(listed, 1, most_listed)).alias("l"))
    return many.join(named, "dst").select(F.col("dst").alias("value"), "cases", F.array_join("l", ", ").alias("case_list"))


def top_shared(edges: DataFrame, top: int = 10) -> DataFrame:
    """The values that most cases share, at least two."""
    return edges.groupBy(F.col("dst").alias("value")).agg(F.countDistinct("src").alias("cases")).where("cases > 1").orderBy(F.desc("cases"), "value").limit(top)


def styled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as a network view takes them."""
    case = F.col("type") == "case"
    color = F.when(case, "#007bff").when(F.col("category") == "Email_Addresses", "#28a745").otherwise("#ffc107")
    n = nodes.select("id", "label", F.col("type").alias("group"), F.when(case, 20).otherwise(5).alias("value"), color.alias("color"), F.when(case, "box").alias("shape"))
    return n, edges.select(F.col("src").alias("from"), F.col("dst").alias("to"))


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and links as JSON lines, one object each: part, json."""
    return nodes.select(F.lit("node").alias("part"), F.to_json(F.struct(*nodes.columns)).alias("json")).unionAll(edges.select(F.lit("link"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"))))
