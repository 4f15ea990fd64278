"""The datasets behind reports, exports and dashboards: aggregations over findings.

Findings have case_name, category, value, file, position, context, first_seen; see `extract`. Where an order decides what
is shown, it is first-seen order within a case, with category and value to settle ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as tx, validate as va

SEEN = F.struct  # (first_seen, value) settles every order below


def category_order(found: DataFrame) -> DataFrame:
    """case_name, category, n, seen: how many findings a category has and where its first one stands."""
    return found.groupBy("case_name", "category").agg(F.count("*").alias("n"), F.min(F.struct("first_seen", "value")).alias("seen"))


def report_rows(found: DataFrame) -> DataFrame:
    """category, value, file_source, position (as shown), with Unknown and N/A where nothing is known."""
    return found.select("case_name", "category", "value", F.coalesce("file", F.lit("Unknown")).alias("file_source"), F.coalesce(F.col("position").cast("string"), F.lit("N/A")).alias("position"))


def report_stats(found: DataFrame) -> DataFrame:
    """Per case: total findings, files, categories and the two largest categories."""
    cats = category_order(found)
    top = cats.groupBy("case_name").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "category"))), 1, 2).alias("top"))
    return found.groupBy("case_name").agg(F.count("*").alias("total"), F.countDistinct("file").alias("files"), F.countDistinct("category").alias("categories")).join(top.select("case_name", F.concat_ws(", ", F.transform("top", lambda t: t["category"])).alias("top_categories")), "case_name")


def live_indicators(found: DataFrame) -> DataFrame:
    """The indicators as the live view lists them, URLs one by one."""
    return found.select("case_name", "category", "value", F.col("context").alias("details"), F.coalesce("file", F.lit("Unknown")).alias("file"), F.coalesce(F.col("position").cast("string"), F.lit("N/A")).alias("position"))


def export_indicators(found: DataFrame) -> DataFrame:
    """The indicators as the export lists them; `Type` wins over `Source`, and URLs stand as their domains."""
    rows = url_domains(found)
    own = F.coalesce(tx.parse_context("context", "Type"), tx.parse_context("context", "Source"), F.lit(""))
    return rows.select("case_name", "category", tx.display_category("category").alias("category_display"), "value", F.coalesce("file", F.lit("Unknown")).alias("file"), F.coalesce(F.col("position").cast("string"), F.lit("N/A")).alias("position"), own.alias("source"), F.coalesce(tx.parse_context("context", "Device"), F.lit("")).alias("device"))


def url_domains(found: DataFrame) -> DataFrame:
    """Findings in which the URLs are replaced by one row per domain, of category URLs_by_Domain (its file and place those of its first URL)."""
    rest = found.where("category <> 'URLs'").select("case_name", "category", "value", "file", "position", "context", "first_seen")
    urls = found.where("category = 'URLs'").withColumn("domain", tx.domain_of("value"))
    first = F.min_by(F.struct("file", "position", "context"), F.struct("first_seen", "value"))
    grouped = urls.groupBy("case_name", "domain").agg(first.alias("f"), F.min("first_seen").alias("first_seen"))
    return rest.unionByName(grouped.select("case_name", F.lit("URLs_by_Domain").alias("category"), F.col("domain").alias("value"), "f.file", "f.position", "f.context", "first_seen"))


def urls_by_domain(found: DataFrame) -> DataFrame:
    """case_name, domain, urls, first_url."""
    u = found.where("category = 'URLs'").select("case_name", tx.domain_of("value").alias("domain"), "value")
    return u.groupBy("case_name", "domain").agg(F.count("*").alias("urls"), F.min("value").alias("first_url"))


def _extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([^./]*)$", 1))


def live_files(found: DataFrame) -> DataFrame:
    """A row per file: name, type, size (not known: 0), indicators, status."""
    g = found.groupBy("case_name", F.coalesce("file", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("indicators"))
    return g.select("case_name", "name", F.coalesce(F.nullif(_extension(F.col("name")), F.lit("")), F.lit("unknown")).alias("type"), F.lit(0).alias("size"), "indicators", F.lit("normal").alias("status"))


def export_files(found: DataFrame) -> DataFrame:
    """A row per file: its indicators, sorted categories and their number."""
    g = found.groupBy("case_name", F.coalesce("file", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("indicators"), F.sort_array(F.collect_set("category")).alias("cats"))
    return g.select("case_name", "name", F.coalesce(F.nullif(_extension(F.col("name")), F.lit("")), F.lit("unknown")).alias("type"), "indicators", F.array_join("cats", ", ").alias("categories"), F.size("cats").cast("long").alias("category_count"))


def live_technical(found: DataFrame) -> DataFrame:
    """case_name, category, count."""
    return found.groupBy("case_name", "category").agg(F.count("*").alias("count"))


def export_technical(found: DataFrame, samples: int = 3) -> DataFrame:
    """A summary row per case, then per category its count and its first values.

    The first values are found by rank, so no category's values are gathered."""
    w = Window.partitionBy("case_name", "category").orderBy("first_seen", "value")
    few = found.select("case_name", "category", "value", "first_seen").withColumn("r", F.row_number().over(w)).where(F.col("r") <= samples)
    first = few.groupBy("case_name", "category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]), ", ").alias("sample_values"))
    counts = found.groupBy("case_name", "category").agg(F.count("*").alias("count"))
    total = counts.groupBy("case_name").agg(F.sum("count").alias("count")).select("case_name", F.lit("Summary").alias("category"), "count", F.lit("").alias("sample_values"))
    return total.unionByName(counts.join(first, ["case_name", "category"]))


def dashboard(found: DataFrame, top: int = 5) -> DataFrame:
    """Per case: indicators, categories and the largest categories, ties in first-seen order."""
    cats = category_order(found)
    return cats.groupBy("case_name").agg(
        F.sum("n").alias("total_indicators"), F.count("*").alias("category_count"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "seen", "category"))), 1, top), lambda x: F.concat(x["category"], F.lit(":"), -x["less"])), ", ").alias("top_categories"),
    )


def recent_export(found: DataFrame, most: int = 10) -> DataFrame:
    """The first findings of each case in category and first-seen order: rank, category, value, file."""
    cats = category_order(found).select("case_name", "category", "seen")
    w = Window.partitionBy("case_name").orderBy("seen", "category", "first_seen", "value")
    return found.join(cats, ["case_name", "category"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("case_name", "rank", "category", "value", "file")


def recent_live(found: DataFrame, most: int = 10) -> DataFrame:
    """The last finding of each of a case's first categories."""
    cats = found.groupBy("case_name", "category").agg(F.max_by(F.struct("value", "file"), F.struct("first_seen", "value")).alias("l"), F.min(F.struct("first_seen", "value")).alias("seen"))
    w = Window.partitionBy("case_name").orderBy("seen", "category")
    return cats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("case_name", "rank", "category", "l.value", "l.file")


def category_facets(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("n")).select("category", "n", F.format_string("%s (%d)", "category", "n").alias("option"))


def file_facets(found: DataFrame) -> DataFrame:
    return found.groupBy(F.coalesce("file", F.lit("Unknown")).alias("file")).agg(F.count("*").alias("n")).select("file", "n", F.format_string("%s (%d)", "file", "n").alias("option"))


def timeline(found: DataFrame) -> DataFrame:
    """Findings that are points in time, in the order of their text (a range-partitioned sort)."""
    return found.where(F.col("category").isin(*fixed.TIMELINE)).orderBy("value", "first_seen", "case_name", "category").select("case_name", "category", "value", "file", "position")


def markers(found: DataFrame) -> DataFrame:
    """Coordinates that are two numbers."""
    p = F.split("value", ",")
    rows = found.where("category = 'GPS_Coordinates'").select("case_name", "value", "file", F.size(p).alias("n"), F.get(p, 0).try_cast("double").alias("lat"), F.get(p, 1).try_cast("double").alias("lon"))
    return rows.where("n = 2 and lat is not null and lon is not null").drop("n")


def case_stats(found: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Per case, by name: indicators (with the entries of its processing summary, if one is stored) and files (never stored: 0)."""
    n = found.groupBy("case_name").agg(F.count("*").alias("indicators"))
    if summaries is not None:
        more = summaries.groupBy("case_name").agg(F.max(F.lit(len(summaries.columns) - 1)).alias("more"))
        n = n.join(more, "case_name", "full").select("case_name", (F.coalesce("indicators", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("indicators"))
    return n.select("case_name", F.col("indicators").cast("long").alias("indicators"), F.lit(0).cast("long").alias("files")).orderBy("case_name")


def global_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("cases"), F.coalesce(F.sum("indicators"), F.lit(0)).cast("long").alias("indicators"), F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"))


def available_cases(found: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases (case_name, created, has_report), with their findings, newest first."""
    n = found.groupBy("case_name").agg(F.count("*").alias("findings"))
    return cases.join(n, "case_name", "left").select("case_name", "created", "has_report", F.coalesce("findings", F.lit(0)).alias("findings"), F.when(F.col("has_report"), "completed").otherwise("processing").alias("status")).orderBy(F.desc("created"), "case_name")


def clean(found: DataFrame) -> DataFrame:
    """Findings that still hold: the whole value matches its pattern, or its first match covers 80 % of it; cards pass the checksum.

    Categories without a pattern are kept."""
    ok = F.lit(True)
    for c, p in fixed.PATTERNS.items():
        whole = F.col("value").rlike(rf"(?diU)\A(?:{p})\z")
        most = F.length(F.regexp_extract("value", f"(?diU){p}", 0)) >= 0.8 * F.length("value")
        ok = F.when(F.col("category") == c, (whole | (F.col("value").rlike(f"(?diU){p}") & most)) & (va.luhn_ok("value") if c in fixed.CARDS else F.lit(True))).otherwise(ok)
    return found.where(ok)


def clean_stats(found: DataFrame) -> DataFrame:
    """Per case and category, per case, and in all (nulls): findings before and after cleaning, and removed. One rollup over both."""
    both = found.select("case_name", "category", F.lit(1).alias("before"), F.lit(0).alias("after")).unionAll(clean(found).select("case_name", "category", F.lit(0), F.lit(1)))
    r = both.rollup("case_name", "category").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return r.select("case_name", "category", "before", "after", (F.col("before") - F.col("after")).alias("removed"))


def case_summary(found: DataFrame, most: int = 10) -> DataFrame:
    """The categories that a written summary of a case lists: the first ones in first-seen order, with their counts."""
    w = Window.partitionBy("case_name").orderBy("seen", "category")
    return category_order(found).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("case_name", "rank", "category", "n")


def extension_histogram(files: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent file extensions."""
    return files.groupBy(F.lower(F.regexp_extract("file_name", r"(\.[^./]*)$", 1)).alias("ext")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(top)


def directory_sizes(files: DataFrame) -> DataFrame:
    """Each folder above a file: how many files it holds, at any depth, their bytes and their size as shown."""
    parts = F.split("file_path", "/")
    each = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder"), "size")
    return each.groupBy("folder").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("shown", tx.format_size("bytes"))
