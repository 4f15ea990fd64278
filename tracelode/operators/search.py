"""Search of texts for strings or a pattern, with what stands around each match."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import files as sources
from .extract import occurrences


def search(texts: DataFrame, terms: list[str], around: int = 50, extensions: list[str] | None = None, regex: bool = False) -> DataFrame:
    """file_path, search_string, match_position, context, archive_depth of every match, whatever its case.

    `texts` has file_path, text and, optionally, archive_depth. With `regex` the first term alone is a pattern."""
    rows = texts if "archive_depth" in texts.columns else texts.withColumn("archive_depth", F.lit(0))
    if extensions:
        rows = rows.where(F.lower("file_path").rlike("(?:" + "|".join(re.escape(e.lower()) for e in extensions) + ")$"))
    if not terms or not terms[0]:
        terms = []
    pairs = [(terms[0], f"(?iU){terms[0]}")] if regex and terms else [(t, "(?iU)\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E") for t in terms if t]
    each = [occurrences(t, p, empty=regex) for t, p in pairs] or [F.array().cast("array<struct<category:string,value:string,position:int>>")]
    hits = rows.where("text is not null").select("file_path", "text", "archive_depth", F.inline(F.concat(*each)))
    return hits.select("file_path", F.col("category").alias("search_string"), F.col("position").alias("match_position"), tx.one_line(tx.window("text", "position", F.length("value"), around)).alias("context"), "archive_depth")


def search_files(files: DataFrame, terms: list[str], strict: bool = False, **how) -> DataFrame:
    """`search` over files and over what zip archives hold at any depth, named as the outermost archive's name, `::` and its own member's path.

    `strict`: a result in a nested archive is named by its whole path."""
    texts = lambda f: f.withColumn("text", sources.decode_utf8("content"))
    zipped = F.col("ext") == ".zip"
    plain = texts(files.where(~F.coalesce(zipped, F.lit(False)))).select("file_path", "text", F.lit(0).alias("archive_depth"))
    outer = F.regexp_extract(F.split_part("file_path", F.lit("::"), F.lit(1)), "([^/]*)$", 1)
    named = F.col("file_path") if strict else F.concat(outer, F.lit("::"), F.split_part("file_path", F.lit("::"), F.lit(2)))
    inner = texts(sources.unpack(files.where(zipped)).where("error is null")).select(named.alias("file_path"), "text", F.col("depth").alias("archive_depth"))
    return search(plain.unionByName(inner), terms, **how)
