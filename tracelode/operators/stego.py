"""Data hidden in the lowest bits of pixels, with array functions: pixels are a column of blue values, one image a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

DELIMITER = "<-END-OF-MESSAGE->"


def bits(data: Column) -> Column:
    """The bits of a binary column, the highest of each byte first."""
    text = F.hex(data)
    nibbles = F.transform(F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(text, i, F.lit(1)), 16, 10).cast("int"))
    return F.flatten(F.transform(nibbles, lambda n: F.array(*(F.shiftright(n, k).bitwiseAND(F.lit(1)) for k in (3, 2, 1, 0)))))


def embed(images: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """`blue` with `data` and the delimiter in its lowest bits, and error where they don't fit (blue is then unchanged)."""
    b = bits(F.concat(F.col("data"), F.lit(delimiter).cast("binary")))
    rows = images.withColumn("__bits", b)
    fits = F.size("__bits") <= F.size("blue")
    mixed = F.transform("blue", lambda p, i: F.when(i < F.size("__bits"), p.bitwiseAND(F.lit(254)).bitwiseOR(F.get("__bits", i))).otherwise(p))
    return rows.withColumn("blue", F.when(fits, mixed).otherwise(F.col("blue"))).withColumn("error", F.when(~fits, "Data is too large to embed")).drop("__bits")


def extract(images: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """data: what stands before the first delimiter at any bit, its whole bytes; error if there is none."""
    text = F.array_join(F.transform("blue", lambda p: p.bitwiseAND(F.lit(1)).cast("string")), "")
    mark = "".join(f"{x:08b}" for x in delimiter.encode())
    at = F.instr(text, mark)
    own = F.substring(text, F.lit(1), at - 1)
    count = F.floor(F.length(own) / 8).cast("int")
    byte = lambda i: F.lpad(F.conv(F.substring(own, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), byte), ""))
    return images.withColumn("data", F.when(at > 0, data)).withColumn("error", F.when(at == 0, "Message delimiter not found"))


def parse_complex(text: Column | str) -> Column:
    """struct(real, imaginary) of a number written like 0.285+0.01j, spaces left out; null if it isn't one."""
    bare = F.lower(F.replace(F.col(text) if isinstance(text, str) else text, F.lit(" "), F.lit("")))
    bare = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
    number = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?"
    real = F.regexp_extract(bare, rf"^([+-]?{number})(?:[+-](?:{number})?j)?$", 1)
    part = F.regexp_extract(bare, rf"^(?:[+-]?{number}(?=[+-]))?([+-]?(?:{number})?)j$", 1)
    unit = F.when(part.isin("", "+"), "1").when(part == "-", "-1").otherwise(part)
    imaginary = F.when(bare.endswith("j"), unit.try_cast("double")).otherwise(F.lit(0.0))
    whole = bare.rlike(rf"^(?:[+-]?{number}(?:[+-](?:{number})?j)?|[+-]?(?:{number})?j)$")
    return F.when(whole, F.struct(F.coalesce(F.when(real != "", real.try_cast("double")), F.lit(0.0)).alias("real"), imaginary.alias("imaginary")))


def _steps(zx: Column, zy: Column, real: Column, imaginary: Column, most: int) -> Column:
    """The iteration (from 0) after which a point is beyond radius 2, or `most`; a batch of points takes each step at once, those that have left take none."""

    @F.pandas_udf("int")
    def steps(a: pd.Series, b: pd.Series, re: pd.Series, im: pd.Series) -> pd.Series:
        z, n = [c.to_numpy(np.float64) for c in (a, b, re, im)], np.zeros(len(a), np.int32)
        at = np.arange(len(n))
        with np.errstate(over="ignore", invalid="ignore"):
            for _ in range(most):
                x, y, u, v = z
                x, y = x * x - y * y + u, 2 * x * y + v
                stays = x * x + y * y <= 4
                z, at = [c[stays] for c in (x, y, u, v)], at[stays]
                if not len(at):
                    break
                n[at] += 1
        return pd.Series(n)

    return steps(zx.cast("double"), zy.cast("double"), real.cast("double"), imaginary.cast("double"))


def julia_of(parameters: DataFrame, width: int, height: int, most: int = 100, span: float = 1.5) -> DataFrame:
    """The columns of `parameters` (real and imaginary among them), x, y, steps: a picture for each row, a row for each of its pixels, so that pixels are spread over tasks.

    Rows of which either number is null have no picture."""
    n = int(parameters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    px = parameters.where("real is not null and imaginary is not null").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).repartition(n).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    zx, zy = (F.col("x") / (width - 1) * 2 - 1) * span, (F.col("y") / (height - 1) * 2 - 1) * span
    return px.select(*parameters.columns, "x", "y", _steps(zx, zy, F.col("real"), F.col("imaginary"), most).alias("steps"))


def julia(spark, width: int, height: int, real: float, imaginary: float, most: int = 100, span: float = 1.5) -> DataFrame:
    """x, y, steps of one picture."""
    one = spark.range(1).select(F.lit(float(real)).alias("real"), F.lit(float(imaginary)).alias("imaginary"))
    return julia_of(one, width, height, most, span).select("x", "y", "steps")


def palette(steps: Column, most: int = 100) -> Column:
    """struct(red, green, blue) of a point's steps, each a cosine wave cut to a byte; points that stay are black."""
    wave = lambda rate: F.when(steps == most, 0).otherwise((F.floor(9 * (1 - F.cos(steps * rate)) * 127.5) % 256).cast("int"))
    return F.struct(*(wave(rate).alias(name) for name, rate in fixed.WAVES.items()))
