"""Structured Streaming: watch, debounce, merge queued work, apply change journals, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import changes, windows


def watch(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def debounce(events: DataFrame, quiet: str = "750 milliseconds", late: str = "10 seconds", key: str = "path", ts: str = "ts") -> DataFrame:
    """One row a path and burst of events, once it has been quiet: path, first, last, n."""
    w = F.session_window(ts, quiet)
    g = events.withWatermark(ts, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.min("size").alias("least"))
    return g.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("last"), "n", (F.col("size") == F.col("least")).alias("stable"))


def windowed_counts(events: DataFrame, width: str, late: str, key: str, ts: str = "ts") -> DataFrame:
    """Counts by key and tumbling window, closed by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(events: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def _next(table: str, batch: int) -> str:
    return f"{table}/v{batch:09d}"


def apply_journal(journal: DataFrame, base: DataFrame, table: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Keeps a versioned table up to date with a change stream; replaying a batch rewrites the same version.

    ``deleted`` of the journal removes a key; the greatest ``seq`` of a key wins, also over
    earlier batches: what each key's was, deletions too, lies beside the versions.  Every
    version is whole, for tables small enough; others take ``apply_journal_buckets``.
    """
    columns = base.columns

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = base.select(*columns) if number == 0 else spark.read.parquet(_next(table, number - 1)).select(*columns)
        known = batch.select(key, seq, "deleted").limit(0) if number == 0 else spark.read.parquet(_next(f"{table}/seen", number - 1))
        last = windows.best(batch, [key], [F.col(seq)])
        fresh = last.join(known.select(key, F.col(seq).alias("_was")), key, "left").where(F.col("_was").isNull() | (F.col(seq) > F.col("_was"))).drop("_was")
        seen = known.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(key, seq, "deleted"))
        seen.write.mode("overwrite").parquet(_next(f"{table}/seen", number))
        changes.apply_changes(before, fresh, key, seq, F.col("deleted")).write.mode("overwrite").parquet(_next(table, number))

    return journal.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_journal_buckets(journal: DataFrame, base: DataFrame, table: str, checkpoint: str, key: str, seq: str, buckets: int = 256) -> StreamingQuery:
    """``apply_journal`` for large tables: keys are dealt to hash buckets and a batch writes anew only those it touches.

    ``data`` has the buckets' files by version, with every key's ``seq`` and whether it is
    deleted; ``manifest`` says, by version, which version of each bucket counts.
    """
    columns = base.columns
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_p")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns, F.col(seq).cast("long").alias("_seq"), F.col("deleted").alias("_deleted"), part)
        touched = [r[0] for r in rows.select("_p").distinct().collect()]  # at most ``buckets``
        if number == 0:
            old = base.select(*columns, F.lit(None).cast("long").alias("_seq"), F.lit(False).alias("_deleted"), part)
            now = dict.fromkeys(range(buckets), 0)
        else:
            now = _versions(spark, table, number - 1)
            old = _read_parts(spark, table, rows.schema, {p: now[p] for p in touched}) if touched else rows.limit(0)
            now |= dict.fromkeys(touched, number)
        last = windows.best(old.unionByName(rows), [key], [F.coalesce("_seq", F.lit(-(1 << 63)))])
        last.select(*columns, "_seq", "_deleted", "_p").write.mode("overwrite").partitionBy("_p").parquet(f"{table}/data/_v={number}")
        spark.createDataFrame(sorted(now.items()), "_p int, v long").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v{number:09d}")

    return journal.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, table: str, number: int) -> dict[int, int]:
    return {r["_p"]: r["v"] for r in spark.read.parquet(f"{table}/manifest/v{number:09d}").collect()}  # a row a bucket


def _read_parts(spark: SparkSession, table: str, schema: StructType, parts: dict[int, int]) -> DataFrame:
    """The buckets, each in its version; Spark prunes the folders by both."""
    versions = sorted(set(parts.values()))
    fields = StructType([f for f in schema.fields if f.name not in ("_p", "_v")])
    rows = spark.read.schema(StructType([*fields.fields, StructField("_v", LongType()), StructField("_p", LongType())])).option("basePath", f"{table}/data").parquet(*(f"{table}/data/_v={v}" for v in versions))
    wanted = F.lit(False)
    for v in versions:
        wanted = wanted | ((F.col("_v") == v) & F.col("_p").isin(*(p for p, x in parts.items() if x == v)))
    return rows.where(wanted).drop("_v").select(*schema.names)


def read_buckets(spark: SparkSession, table: str, columns: list[str]) -> DataFrame:
    """The live rows of the newest version of a table that ``apply_journal_buckets`` keeps."""
    files = spark.read.parquet(f"{table}/manifest/*").select(F.regexp_extract(F.input_file_name(), r"/v(\d{9})/", 1).cast("long").alias("n"))
    number = files.agg(F.max("n")).first()[0]
    parts = _versions(spark, table, number)
    schema = spark.read.parquet(f"{table}/data/_v={number}").drop("_v").schema
    return _read_parts(spark, table, schema, parts).where(~F.col("_deleted")).select(*columns)


def collect_once(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into a Parquet folder and reads it."""
    q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def running_state(events: DataFrame, key: str, value: str, gap_s: float, ts: str = "ts") -> DataFrame:
    """Per-key state over a stream: (key, chain, n, total), a new chain after a pause longer than ``gap_s``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):
        last, chain, n, total = state.get if state.exists else (None, 0, 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(ts)
        for t, v in zip(rows[ts], rows[value], strict=True):
            at = t.timestamp()
            if last is None or at - last > gap_s:
                chain, n, total = chain + 1, 0, 0.0
            n, total, last = n + 1, total + float(v), at
        state.update((last, chain, n, total))
        yield pd.DataFrame({key: [k[0]], "chain": [chain], "n": [n], "total": [total]})

    out = f"{key} long, chain long, n long, total double"
    return events.groupBy(key).applyInPandasWithState(step, out, "last double, chain long, n long, total double", "update", GroupStateTimeout.NoTimeout)
