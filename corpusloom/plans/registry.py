"""The registry of queries: name -> function, and name -> SQL where there is one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Tables of texts, whose rows cost enough work to be spread.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it has fewer partitions: one small file, or one row group, is one task else. A table that has
    enough partitions is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_OWN: list[str] = []


def scratch(spark, name: str) -> str:
    """A new folder where driver and executors can both write: under ``spark.checkpoint.dir``, else a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        _OWN[:] = _OWN or [tempfile.mkdtemp(prefix="corpusloom-")]
        base = _OWN[0]
    return f"{base.rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to a scratch table and read it back, for steps that take it more than once."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query(name: str, sql: str | None = None):
    """Register a query; small integers become longs, so that both engines give the same types."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            small = {x.name: F.col(x.name).cast("long") for x in df.schema.fields if x.dataType.simpleString() in ("int", "smallint", "tinyint")}
            return df.withColumns(small) if small else df

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register
