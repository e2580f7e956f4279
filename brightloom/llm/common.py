"""What the operators share: tables, the shared folder, cutting lineage, and
joins whose broadcast side has been measured first."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine, as in tests, a
    temporary folder is made and set.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="brightloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def run_dir(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcasting if it has at most `most` rows."""
    return F.broadcast(df) if rows <= most else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it, for workers that read or write shared files by themselves."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def kept(key: str, make: Callable[[], object]) -> object:
    """make(), called once in each Python worker process; the two newest are held.

    Functions are shipped to workers by value, with globals of their own for
    each task, so what is to outlast a task hangs on a module of the process.
    """
    held = sys.modules.setdefault("_corpus_kept", types.ModuleType("_corpus_kept")).__dict__.setdefault("held", {})
    if key not in held:
        while len(held) > 1:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]
