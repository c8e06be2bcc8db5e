"""Factor files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_factor_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """date, factor, r from text lines 'YYYYMMDD, percent, percent, ...'; other lines (headers, yearly parts) go. lines: value."""
    cells = F.split(F.trim("value"), r"\s*,\s*")
    rows = lines.select(cells.alias("c")).filter(F.rlike(F.get("c", F.lit(0)), F.lit(r"^\d{8}$")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("factor"), (F.get("c", F.lit(i)).cast("double") / 100).alias("r")) for i, n in enumerate(names, 1)])).alias("x")
    return rows.select(F.to_date(F.get("c", F.lit(0)), "yyyyMMdd").alias("date"), each).select("date", "x.factor", "x.r").filter("r is not null")


def read_factor_file(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return parse_factor_lines(spark.read.text(path), names)


def joined_factors(base: DataFrame, more: DataFrame) -> DataFrame:
    """Both factor tables on the dates that both have."""
    days = base.select("date").distinct().join(more.select("date").distinct(), "date")
    return base.unionByName(more).join(days, "date", "left_semi")


def excess_over_market(returns: DataFrame, market: str) -> DataFrame:
    """date, factor, r: the market's return as MKT, others less the market's."""
    m = returns.filter(F.col("asset") == market).select("date", F.col("r").alias("m"))
    rest = returns.filter(F.col("asset") != market).join(m, "date").select("date", F.col("asset").alias("factor"), (F.col("r") - F.col("m")).alias("r"))
    return m.select("date", F.lit("MKT").alias("factor"), F.col("m").alias("r")).unionByName(rest)
