"""Session-level helpers: settings and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

# Rows and bytes up to which a result counts as small enough for the driver and for a broadcast.
SMALL_TABLE_ROWS = 100_000
SMALL_TABLE_BYTES = 32 << 20


def tuned_session(app_name: str = "loanvane", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are written for; ``conf`` overrides them.

    Shuffle partition counts are left to adaptive execution, which coalesces from the
    initial number; on a cluster give ``spark.sql.shuffle.partitions`` about 2-3 x cores.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # the JVM never compiles longer methods; without generated code such stages run faster
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, tag: str) -> str:
    """Path of a new folder under ``spark.checkpoint.dir``, deleted when the application ends.

    Only a local session may leave the setting out; it then gets a folder of its own.
    """
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loan-stage-")
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_folder`` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's collector finds their jobs unreachable, which may be long after their last use: collect now."""
    spark._jvm.System.gc()


def small_table(df: DataFrame, limit: int = SMALL_TABLE_ROWS, max_bytes: int = SMALL_TABLE_BYTES) -> DataFrame:
    """Evaluate ``df`` once; a result within both bounds is handed back as local data.

    A local relation has known size, so Catalyst broadcasts it by itself. Rows come to the
    driver partition by partition and stop at the limit. A larger result is handed back as the cached
    table that was read from, so joins to it stay shuffle joins and nothing is computed twice.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = held.limit(limit + 1).collect()
    if len(rows) <= limit:
        table = pa.Table.from_pylist([r.asDict(recursive=True) for r in rows], schema=to_arrow_schema(df.schema))
        if table.nbytes <= max_bytes:
            held.unpersist()
            return df.sparkSession.createDataFrame(table, schema=df.schema)
    return held


def bounded_rows(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> list:
    """Collect a result that must be small by construction; refuse it otherwise."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows where a small table was expected")
    return rows
