"""CSV and report tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATIONS = "city string, station string, display_name string, timezone string, latitude double, longitude double, resolution_station string, resolution_source string"
# fixed values: column order of the observation export.
ASOS = ("station", "valid", "tmpf", "dwpf", "sknt", "drct", "relh", "mslp", "p01i", "vsby", "alti", "feel", "skyc1", "skyc2", "skyc3")
TEXT_COLUMNS = {"station", "skyc1", "skyc2", "skyc3"}


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns in order; a missing one is null and NaN in a double becomes null."""
    out = []
    for field in schema.fields:
        column = F.col(field.name).try_cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            column = F.when(~F.isnan(column), column)
        out.append(column.alias(field.name))
    return df.select(*out)


def read_features(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header whose columns may be a subset of the schema, matched by name."""
    raw = spark.read.option("header", True).csv(path)
    return ensure_columns(raw, schema)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def read_asos(spark: SparkSession, path: str) -> DataFrame:
    """Station observations: `M` is null, trace precipitation `T` is zero, header names in any case, times in UTC."""
    raw = spark.read.option("header", True).option("nullValue", "M").option("comment", "#").csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    out = []
    for name in ASOS:
        if name not in raw.columns:
            out.append(F.lit(None).cast("string" if name in TEXT_COLUMNS else "double").alias(name))
            continue
        text = F.trim(F.col(name))
        value = F.when(text != "M", text)
        if name == "valid":
            value = value.try_cast("timestamp")
        elif name == "p01i":
            value = F.when(value == "T", 0.0).otherwise(value.try_cast("double"))
        elif name not in TEXT_COLUMNS:
            value = value.try_cast("double")
        out.append(value.alias(name))
    return raw.select(*out).where("valid is not null")


def read_daily_truth(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """Daily values with year, month, day, value, completeness; rows that are not numbers (preamble, gaps) are left out."""
    raw = spark.read.csv(path, schema="year string, month string, day string, value string, completeness string")
    y, m, d, v = (F.trim(F.col(c)) for c in ("year", "month", "day", "value"))
    rows = raw.select(y.try_cast("int").alias("y"), m.try_cast("int").alias("m"), d.try_cast("int").alias("d"), v.try_cast("double").alias(metric), "completeness")
    rows = rows.where(F.col("y").isNotNull() & F.col("m").between(1, 12) & F.col("d").between(1, 31) & F.col(metric).isNotNull())
    return rows.select(F.expr("try_to_date(concat_ws('-', y, m, d), 'y-M-d')").alias("market_date"), metric, "completeness").where("market_date is not null")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Station dimension; Spark broadcasts it by its measured size where that fits."""
    return read_features(spark, path, T.StructType.fromDDL(STATIONS))


def write_ranked(df: DataFrame, path: str, order: list, fmt: str = "csv") -> None:
    """Ranked table as sorted part files; no partition is forced into one."""
    writer = df.orderBy(*order).write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))


def row_set_hash(df: DataFrame) -> DataFrame:
    """Order-free identity of a row set: count and two sums of 60 bits each of the digest of every row's JSON."""
    digest = F.md5(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))

    def sum_of(start: int):
        return F.sum(F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")).cast("string")

    return df.agg(F.count(F.lit(1)).alias("rows"), sum_of(1).alias("sum_a"), sum_of(16).alias("sum_b"))
