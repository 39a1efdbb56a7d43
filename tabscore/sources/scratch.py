"""Intermediate tables: kept by Spark, or written to the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str | None:
    """The folder of ``spark.checkpoint.dir``, or None where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return root.rstrip("/") if root else None


def scratch_root(spark: SparkSession) -> str:
    """Folder for files that all executors share: the checkpoint folder, else the session's warehouse.

    A warehouse on the local disk is shared in local mode only; on a cluster it raises.
    """
    root = checkpoint_root(spark)
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        scheme = path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        master = spark.sparkContext.master
        if scheme == "file" and not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{root} is a local folder of each machine: set spark.checkpoint.dir to a shared one")
    return root


_made: dict[str, set[str]] = {}  # by application: the folders that it has made


def made(spark: SparkSession, path: str) -> str:
    """Note a folder that ``release_scratch`` is to delete."""
    _made.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    return made(spark, f"{scratch_root(spark)}/tabscore-{name}-{uuid.uuid4().hex}")


def release_scratch(spark: SparkSession) -> int:
    """Delete all files that this application has written for itself, and return the number of folders.

    Frames that read them are lost: call it when every result is written elsewhere.
    """
    paths = _made.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        delete_path(spark, path)
    return len(paths)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Compute ``df`` once for several readers (a fit and a transform, the two passes of a prefix sum).

    With a checkpoint folder the rows are written there and read back: later
    readers prune columns, and a lost executor costs a re-read. Without one the
    frame is persisted: the lineage stays, and ``release`` frees the storage.
    """
    spark = df.sparkSession
    if checkpoint_root(spark) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return write_table(df, scratch_path(spark, name))


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back with the same schema."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Free what ``materialize`` keeps of ``df``; files in the checkpoint folder go with that folder."""
    df.unpersist()


def discard(df: DataFrame) -> None:
    """Free what ``materialize`` keeps of ``df``, files in the checkpoint folder too: for a table that is not read again."""
    release(df)
    spark = df.sparkSession
    if checkpoint_root(spark) is not None:
        folders, mine = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}, _made.get(spark.sparkContext.applicationId, set())
        for path in [p for p in mine if p.rsplit("/", 1)[-1] in folders]:
            delete_path(spark, path)
            mine.discard(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete one scratch table through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
