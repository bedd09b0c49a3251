"""Lineage cuts in the shared checkpoint folder, and sizes that bound partitions."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names.  Where none is set: a temporary one in local
    mode, a folder of the warehouse, which all executors share, on a cluster."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="galleon-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/galleon-cuts"
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the executors that made them."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(docs: DataFrame, column: str = "text", block_mb: int = 16, finer: int = 1) -> int | tuple[int, int]:
    """How many hash blocks keep a block's text near ``block_mb``: grows with the table.

    With ``finer``, also the number for blocks that many times smaller.
    """
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    least = 2 * partitions(docs.sparkSession)
    found = tuple(max(least, math.ceil(total * f / (block_mb << 20))) for f in (1, finer))
    return found if finer > 1 else found[0]


#: Tables that stages of a chain have written, by the chain's key, and the chain that is writing now.
_made: dict[str, list[str]] = {}
_now: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: compact, read again by column."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _now:
        _made[_now[-1]].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(df: DataFrame) -> set[str]:
    """Names of the written tables among a plan's files."""
    return {name for f in df.inputFiles() for name in f.split("/")[-2:-1] if name.startswith("table-")}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and whose last use is over."""
    for df in tables:
        for name in _tables(df):
            _delete(df.sparkSession, f"{folder(df.sparkSession)}/{name}")


@contextlib.contextmanager
def stage(key: str, docs: DataFrame, first: bool = False) -> Iterator[None]:
    """Within a chain of stages, each of which reads what the one before has written in full: tables of
    earlier stages go, save those that ``docs`` itself still reads.  ``first`` begins a chain."""
    spark, held = docs.sparkSession, _tables(docs)
    before = [] if first else _made.get(key, [])
    for path in before:
        if path.rsplit("/", 1)[-1] not in held:
            _delete(spark, path)
    _made[key] = [p for p in before if p.rsplit("/", 1)[-1] in held]
    _now.append(key)
    try:
        yield
    finally:
        _now.pop()
