"""Enrichment by joins with local tables, in place of network services, and the rules for risk.

Address blocks join by range without a nested loop and without expanding them: addresses and blocks are swept together, in order."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text as tx, validate as va
from ..sources.shared import cut

IP_CATEGORIES = ["IPv4", "IPv4_with_Port"]


def area_codes(spark) -> DataFrame:
    return spark.createDataFrame(fixed.AREA_CODES, "area_code string, state string, city string, timezone string")


def with_area(phones: DataFrame, codes: DataFrame, value: str = "value") -> DataFrame:
    """Phone numbers with the state, city and time zone of their area code (`codes`: area_code, state, city, timezone)."""
    d = va.digits(value)
    code = F.when(d.startswith("1") & (F.length(d) == 11), F.substring(d, 2, 3)).otherwise(F.substring(d, 1, 3))
    return phones.withColumn("area_code", code).join(codes, "area_code", "left")


def routing_info(numbers: DataFrame, banks: DataFrame, value: str = "value") -> DataFrame:
    """Numbers that pass the checksum, with their bank where `banks` (routing_number, bank) names one."""
    return numbers.where(va.routing_checksum(value)).join(banks, F.col(value) == F.col("routing_number"), "left").drop("routing_number")


_EVENT = "__range int, __pos long, __kind int, __end long, __width long, __id long"


def smallest_holding(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """n and id of the smallest block (start, end, id; of equal ones that of the smaller start, then id) that holds each point n; points in no block are left out.

    A sweep over the line: it is cut at quantiles of points and starts together, so that parts are of like size wherever either crowd. A block is a row, and one more
    for each cut that it lies across. Each part is swept in order: blocks open at their starts, the smallest open one answers a point, and what has
    ended goes when it comes up. Blocks may nest, touch or cross."""
    spark = points.sparkSession
    good = blocks.where("end >= start and start is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = points.select(F.col("n").alias("x")).unionAll(good.select("start"))
    cuts = np.array(sorted({int(c) for c in marks.approxQuantile("x", [k / parts for k in range(1, parts)], 0.002)}), np.int64)  # as many numbers as there are partitions

    def opening(batches):
        for b in batches:
            start, end, ident = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            first, last = np.searchsorted(cuts, start, "right"), np.searchsorted(cuts, end, "right")
            row = np.repeat(np.arange(len(start)), last - first + 1)
            part = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            pos = np.where(part == first[row], start[row], cuts[np.maximum(part - 1, 0)] if len(cuts) else 0)
            yield _event(part, pos, 0, end[row], (end - start)[row], ident[row])

    def asking(batches):
        for b in batches:
            n = b.column(0).to_numpy(zero_copy_only=False)
            yield _event(np.searchsorted(cuts, n, "right"), n, 1, n, n, n)

    def sweep(batches):
        part, open_ = None, []
        for b in batches:
            found: list[tuple[int, int]] = []
            for r, pos, kind, end, width, ident in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != part:
                    part, open_ = r, []
                if not kind:
                    heapq.heappush(open_, (width, end, ident))
                    continue
                while open_ and open_[0][1] < pos:
                    heapq.heappop(open_)
                if open_:
                    found.append((pos, open_[0][2]))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], names=["n", "id"])

    events = good.select("start", "end", "id").mapInArrow(opening, _EVENT).unionAll(points.select("n").mapInArrow(asking, _EVENT))
    return events.repartition(parts, "__range").sortWithinPartitions("__range", "__pos", "__kind", "__width", "__end", "__id").mapInArrow(sweep, "n long, id long")


def _event(part, pos, kind: int, end, width, ident) -> pa.RecordBatch:
    columns = (part.astype(np.int32), pos.astype(np.int64), np.full(len(part), kind, np.int32), end.astype(np.int64), width.astype(np.int64), ident.astype(np.int64))
    return pa.record_batch([pa.array(c) for c in columns], names=[f.split(" ")[0] for f in _EVENT.split(", ")])


def geo_lookup(ips: DataFrame, blocks: DataFrame, ip: str = "ip") -> DataFrame:
    """Each different address with the smallest block that holds it: ip, country, region, city, asn, lat, lon, source, error.

    `blocks` has start_ip, end_ip (numbers) and those columns."""
    own = cut(ips.select(F.col(ip).alias("ip")).distinct().withColumn("n", va.ip_number("ip")))
    cols = [c for c in blocks.columns if c not in ("start_ip", "end_ip")]
    known = cut(blocks.select(F.col("start_ip").alias("start"), F.col("end_ip").alias("end"), F.monotonically_increasing_id().alias("id"), F.struct(*cols).alias("b")))
    good = own.where(~va.non_global_ip("ip") & F.col("n").isNotNull())
    hit = smallest_holding(good.select("n").distinct(), known).join(known.select(F.col("id").alias("of"), "b"), F.col("id") == F.col("of")).select(F.col("n").alias("at"), "b")
    error = F.when(va.non_global_ip("ip"), "Invalid or non-global IP address").when(F.col("b").isNull(), "No data available")
    joined = own.join(hit, (F.col("n") == F.col("at")) & ~va.non_global_ip("ip"), "left")
    return joined.select("ip", *(F.col(f"b.{c}").alias(c) for c in cols), error.alias("error"))


def first_known(primary: DataFrame, fallback: DataFrame, key: str = "ip") -> DataFrame:
    """Rows of the first source, filled from the second where the first has an error or nothing."""
    other = fallback.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in fallback.columns if c != key))
    rows = primary.join(other, F.col(key) == F.col("__k"), "left")
    found = F.col("__k").isNotNull()
    filled = [F.coalesce(c, f"__{c}").alias(c) if f"__{c}" in other.columns else F.col(c) for c in primary.columns if c not in (key, "error")]
    return rows.select(key, *filled, F.when(~found, F.col("error")).alias("error"))


def geo_risk_live(country: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "Low").when(country.isin(*fixed.LIVE_HIGH), "High").when(country.isin(*fixed.LIVE_LOW), "Low").otherwise("Medium")


def geo_risk_export(country: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "Low").when(country.isin(*fixed.EXPORT_MEDIUM), "Medium").otherwise("Low")


def geographic_live(found: DataFrame, geo: DataFrame, listed: int = 3) -> DataFrame:
    """A row for each address of each case, with or without port, enriched by the address alone; files listed by name, three at most.

    The first three files are found by rank, so a frequent address gathers nothing."""
    ips = found.where(F.col("category").isin(*IP_CATEGORIES)).select("case_name", F.col("value").alias("ip"), F.coalesce("file", F.lit("Unknown")).alias("file"))
    counted = ips.groupBy("case_name", "ip").agg(F.count("*").alias("indicators"), F.countDistinct("file").alias("n_files"))
    w = Window.partitionBy("case_name", "ip").orderBy("file")
    few = ips.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= listed).groupBy("case_name", "ip").agg(F.array_join(F.sort_array(F.collect_list("file")), ", ").alias("files"))
    more = F.when(F.col("n_files") > listed, F.format_string(" (+%d more)", F.col("n_files") - listed)).otherwise("")
    rows = counted.join(few, ["case_name", "ip"]).withColumn("bare", F.split_part("ip", F.lit(":"), F.lit(1)))
    g = geo.select(F.col("ip").alias("__ip"), "country", "city", "asn", "error")
    out = rows.join(g, F.col("bare") == F.col("__ip"), "left")
    known = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    return out.select("case_name", "ip", known("country"), known("city"), known("asn"), geo_risk_live(F.coalesce("country", F.lit("Unknown")), F.col("error")).alias("risk"), "indicators", F.concat("files", more).alias("files"))


def geographic_export(found: DataFrame, geo: DataFrame, listed: int = 5) -> DataFrame:
    """The exported rows: an address each (only values that are bare addresses are enriched), and a row for each coordinate pair."""
    ips = found.where(F.col("category").isin(*IP_CATEGORIES)).select("case_name", F.col("value").alias("ip"), F.coalesce("file", F.lit("Unknown")).alias("file"))
    w = Window.partitionBy("case_name", "ip").orderBy("file")
    few = ips.distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= listed).groupBy("case_name", "ip").agg(F.sort_array(F.collect_list("file")).alias("files"))
    n = ips.groupBy("case_name", "ip").agg(F.count("*").alias("indicators"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = n.join(few, ["case_name", "ip"]).join(geo, "ip").select(
        "case_name", F.lit("IP").alias("type"), "ip", blank("country"), blank("region"), blank("city"), blank("asn"), blank("lat"), blank("lon"), geo_risk_export(F.col("country"), F.col("error")).alias("risk"), "indicators", "files", F.coalesce("source", F.lit("Unknown")).alias("source")
    )
    p = F.split("value", ",")
    gps = found.where("category = 'GPS_Coordinates'").select("case_name", "value", F.coalesce("file", F.lit("Unknown")).alias("file"), F.get(p, 0).try_cast("double").alias("lat"), F.get(p, 1).try_cast("double").alias("lon")).where("lat is not null and lon is not null")
    none = F.lit("")
    more = gps.select("case_name", F.lit("GPS").alias("type"), F.col("value").alias("ip"), none.alias("country"), none.alias("region"), none.alias("city"), none.alias("asn"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.lit("Low").alias("risk"), F.lit(1).cast("long").alias("indicators"), F.when(F.col("file") != "Unknown", F.array("file")).otherwise(F.array().cast("array<string>")).alias("files"), F.lit("EXIF").alias("source"))
    return rows.unionByName(more)


def report_enrichment(found: DataFrame, geo: DataFrame) -> DataFrame:
    """Findings that are addresses, with the enrichment as the report shows it (joined on the exact value)."""
    g = geo.select(F.col("ip").alias("__ip"), tx.enrichment_text("country", "city", "asn", "error").alias("enrichment"))
    return found.where(F.col("category").isin("IPv4", "IPv6")).join(g, F.col("value") == F.col("__ip"), "left").drop("__ip")


def ip_threats(found: DataFrame, geo: DataFrame, abuse: DataFrame, devices: DataFrame) -> DataFrame:
    """case_name, indicator, type, severity, source, confidence for every address, by abuse reports, known weaknesses and country.

    `abuse`: ip, abuse_confidence, total_reports; `devices`: ip, vulnerabilities (array). Of several rows for an address the worst counts."""
    ips = found.where(F.col("category").isin(*IP_CATEGORIES)).select("case_name", F.col("value").alias("indicator"), F.coalesce("file", F.lit("Unknown")).alias("source"), F.split_part("value", F.lit(":"), F.lit(1)).alias("bare"))
    a = abuse.groupBy(F.col("ip").alias("__a")).agg(F.max("abuse_confidence").alias("c"), F.max("total_reports").alias("reports"))
    d = devices.groupBy(F.col("ip").alias("__d")).agg(F.max(F.size("vulnerabilities")).alias("weak"))
    g = geo.select(F.col("ip").alias("__g"), "country")
    j = ips.join(a, F.col("bare") == F.col("__a"), "left").join(d, F.col("bare") == F.col("__d"), "left").join(g, F.col("bare") == F.col("__g"), "left")
    over = lambda limits: (F.col("c") > limits[0]) | (F.col("reports") > limits[1])
    upto = lambda rule, n: F.least(F.lit(rule[1]), rule[0] + n)
    bad, some = over(fixed.ABUSE_BAD), over(fixed.ABUSE_SOME)
    base = F.when(bad, upto(fixed.SURE_BAD, F.col("c"))).when(some, upto(fixed.SURE_SOME, F.col("c"))).otherwise(fixed.SURE_OTHER)
    weak = F.coalesce(F.col("weak") > 0, F.lit(False))
    kind = F.when(weak, "vulnerable_device").when(bad, "malicious_ip").otherwise("suspicious_ip")
    j = j.withColumn("kind", kind).withColumn("base", base)
    placed = (F.col("kind") == "suspicious_ip") & F.col("__g").isNotNull()
    high, low = F.col("country").isin(*fixed.LIVE_HIGH), F.col("country").isin(*fixed.THREAT_LOW)
    severity = F.when(weak, F.when(F.col("weak") > fixed.WEAK_SEVERE, "high").otherwise("medium")).when(bad, "high").when(placed & high, "high").when(placed & low, "low").otherwise("medium")
    sure = F.when(weak, F.least(F.lit(fixed.SURE_WEAK[1]), F.col("base") + F.col("weak") * fixed.SURE_WEAK[0])).when(bad, F.col("base")).when(placed, F.when(high, fixed.SURE_HIGH).when(low, fixed.SURE_LOW).otherwise(fixed.SURE_MIDDLE)).otherwise(F.col("base"))
    return j.select("case_name", "indicator", F.col("kind").alias("type"), severity.alias("severity"), "source", sure.cast("double").alias("confidence"))


def url_threats(found: DataFrame, scans: DataFrame) -> DataFrame:
    """The same for every URL, by scan results (`scans`: url, positives, total_scans) or else by what stands in it."""
    urls = found.where("category = 'URLs'").select("case_name", F.col("value").alias("indicator"), F.coalesce("file", F.lit("Unknown")).alias("source"))
    s = scans.select(F.col("url").alias("__u"), "positives", "total_scans")
    j = urls.join(s, F.col("indicator") == F.col("__u"), "left")
    low = F.lower("indicator")
    has = lambda words: F.coalesce(*(F.when(F.contains(low, F.lit(w)), True) for w in words), F.lit(False))
    scanned, hit = F.col("__u").isNotNull(), F.col("positives") > 0
    pick = lambda found_, clean, bad, short, cheap, other: F.when(scanned & hit, found_).when(scanned, clean).when(has(fixed.URL_MALWARE), bad).when(has(fixed.URL_SHORT), short).when(has(fixed.URL_CHEAP), cheap).otherwise(other)
    sure = F.least(F.lit(fixed.SURE_SCAN[1]), fixed.SURE_SCAN[0] + F.try_divide(F.col("positives") * 100.0, "total_scans"))
    return j.select(
        "case_name", "indicator", pick(F.lit("malware"), F.lit("clean_url"), F.lit("malware"), F.lit("suspicious_url"), F.lit("suspicious_url"), F.lit("suspicious_url")).alias("type"),
        pick(F.when(F.col("positives") > fixed.SCANS_SEVERE, "high").otherwise("medium"), F.lit("low"), F.lit("high"), F.lit("medium"), F.lit("medium"), F.lit("low")).alias("severity"), "source",
        pick(sure, *map(F.lit, (fixed.SURE_CLEAN, fixed.SURE_MALWARE, fixed.SURE_SHORT, fixed.SURE_CHEAP, fixed.SURE_NOTHING))).alias("confidence"),
    )


def exposures(found: DataFrame, every: bool = False) -> DataFrame:
    """Exposed personal data: effective, the last value of each category; `every`: each value."""
    rows = found.where(F.col("category").isin(*fixed.EXPOSED))
    if not every:
        last = rows.groupBy("case_name", "category").agg(F.max_by(F.struct("value", "file"), F.struct("first_seen", "value")).alias("l"))
        rows = last.select("case_name", "category", "l.value", "l.file")
    worst = F.col("category").isin("Credit_Cards", "SSN")
    return rows.select("case_name", F.col("value").alias("indicator"), F.lit("data_exposure").alias("type"), F.when(worst, "high").otherwise("medium").alias("severity"), F.coalesce("file", F.lit("Unknown")).alias("source"), F.when(worst, fixed.SURE_WORST).otherwise(fixed.SURE_EXPOSED).alias("confidence"))


def security_live(found: DataFrame, geo: DataFrame, abuse: DataFrame, devices: DataFrame, scans: DataFrame) -> DataFrame:
    """Every threat row of the live view."""
    return ip_threats(found, geo, abuse, devices).unionByName(url_threats(found, scans)).unionByName(exposures(found))


def security_export(found: DataFrame) -> DataFrame:
    return found.where(F.col("category").isin(*fixed.SECURITY_EXPORT)).select("case_name", "category", "value", F.col("context").alias("details"), F.coalesce("file", F.lit("Unknown")).alias("file"))


def with_intel(found: DataFrame, **dims: tuple[DataFrame, str]) -> DataFrame:
    """Findings with a map of what each table (name=(table, key column)) says of the value, as JSON; tables' rows with an `error` don't count."""
    rows, names = found, []
    for name, (table, key) in dims.items():
        good = table.where("error is null") if "error" in table.columns else table
        t = good.select(F.col(key).alias(f"__{name}"), F.to_json(F.struct(*(c for c in good.columns if c != key))).alias(name)).dropDuplicates([f"__{name}"])
        rows = rows.join(t, F.split_part("value", F.lit("|"), F.lit(1)) == F.col(f"__{name}"), "left").drop(f"__{name}")
        names.append(name)
    held = F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))
    return rows.withColumn("enrichments", F.map_filter(held, lambda _, v: v.isNotNull())).drop(*names)
