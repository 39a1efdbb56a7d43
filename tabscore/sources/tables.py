"""Scans and sinks for contest, feature and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FEATURES = [f"f{i}" for i in range(1, 15)]

TRAINING_SCHEMA = T.StructType(
    [T.StructField(f, T.IntegerType()) for f in FEATURES]
    + [
        T.StructField("c1", T.StringType()),
        T.StructField("validation", T.IntegerType()),
        T.StructField("target", T.IntegerType()),
    ]
)
TOURNAMENT_SCHEMA = T.StructType(
    [T.StructField("t_id", T.LongType())]
    + [T.StructField(f, T.IntegerType()) for f in FEATURES]
    + [T.StructField("c1", T.StringType())]
)
SUBMISSION_SCHEMA = T.StructType(
    [T.StructField("t_id", T.LongType()), T.StructField("probability", T.DoubleType())]
)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, partitions: int | None = None
) -> DataFrame:
    """Read a header CSV (plain or ``.gz``) or, for any other path, parquet.

    A gz file cannot be split, so a single big ``.csv.gz`` is read by one task;
    ``partitions`` spreads its rows for what follows. ``write_features`` writes
    many parts, which need no such step.
    """
    df = _scan(spark, path, schema)
    return df if partitions is None else df.repartition(partitions)


def _scan(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        if schema is None:
            raise ValueError("a CSV scan needs a schema: inferring one reads the data twice")
        return (
            spark.read.schema(schema)
            .options(header=True, nullValue="NA", enforceSchema=False, mode="FAILFAST")
            .csv(path)
        )
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(SUBMISSION_SCHEMA)
        .options(header=True, nullValue="NA", enforceSchema=False, mode="FAILFAST")
        .csv(path)
    )


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature table sink: parquet by default, ``csv`` or ``csv.gz`` for exchange."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt in ("csv", "csv.gz"):
        compression = "gzip" if fmt == "csv.gz" else "none"
        df.write.mode("overwrite").options(header=True, compression=compression, nullValue="NA").csv(path)
    else:
        raise ValueError(f"unknown feature format {fmt!r}")


def write_submission(
    df: DataFrame, path: str, key: str = "t_id", probability: str = "probability", files: int | None = None
) -> None:
    """Write ``key, probability`` as header CSV parts.

    The number of parts follows the data; ``files=1`` is for an upload form
    that takes one file.
    """
    out = df.select(df[key].cast("long").alias("t_id"), df[probability].cast("double").alias("probability"))
    if files is not None:
        out = out.repartition(files)
    out.write.mode("overwrite").options(header=True, nullValue="NA").csv(path)
