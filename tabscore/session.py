"""Session options that the wide projections of this library depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# HotSpot never compiles a method of more than 8000 bytes. Spark's own limit for
# one generated method is the largest legal size, so a projection with a few
# dozen scaled columns would run interpreted (measured: ten times slower). Above
# this limit Spark generates one method per expression group instead.
_DEFAULT_METHOD_LIMIT = "65535"
_HOTSPOT_METHOD_LIMIT = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Set what is still at its default; options chosen by the user stay."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == _DEFAULT_METHOD_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", _HOTSPOT_METHOD_LIMIT)
    return spark
