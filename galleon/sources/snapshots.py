"""Snapshots of tables by generations: only what changed is written, and what was written can be proved.

A table's rows are dealt to buckets by their key.  A bucket's address is made from its content (its number, its
rows and two sums of row hashes, whatever their order), so a bucket that is as before is already there and
is not written again.  A generation is a manifest of addresses, written after all its buckets:
a run that breaks off leaves buckets that no manifest names, and the same run again writes the same addresses over them.

Sums of 64-bit hashes find damage and torn writes; they are no defence against someone who forges rows.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "table string, schema string, bucket int, rows long, address string, _g int"
BUCKETS = 256


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _addresses(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, rows, address) of rows that have a bucket."""
    names = [F.col(f"`{c}`") for c in columns]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *names).cast("decimal(38,0)")).cast("string")
    g = rows.groupBy(F.col("_bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), total(1).alias("a"), total(2).alias("b"))
    return g.select("bucket", "rows", F.concat_ws("-", F.lpad(F.col("bucket").cast("string"), 6, "0"), F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "a", "b"), 256)).alias("address"))


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def generations(spark: SparkSession, folder: str) -> list[int]:
    """The complete generations, oldest first."""
    return sorted(r["_g"] for r in _manifests(spark, folder).select("_g").distinct().collect())


def take(tables: dict[str, tuple[DataFrame, str]], folder: str, buckets: int = BUCKETS) -> tuple[int, int]:
    """(generation, buckets written) of a snapshot of tables, each with its key column.  Maps are not supported."""
    spark = next(iter(tables.values()))[0].sparkSession
    number, written, lists = max(generations(spark, folder), default=0) + 1, 0, []
    known = _manifests(spark, folder).select("table", "address").distinct()
    for name, (df, key) in tables.items():
        rows = df.withColumn("_bucket", _bucket(key, buckets))
        found = _addresses(rows, df.columns)
        at = f"{folder}/addresses/_g={number}/{name}"
        found.write.mode("overwrite").parquet(at)
        found = spark.read.schema("bucket int, rows long, address string").parquet(at)
        new = found.join(known.where(F.col("table") == name).select("address"), "address", "left_anti").select(F.col("bucket").alias("_bucket"), F.col("address").alias("_address"))
        some = rows.join(F.broadcast(new), "_bucket")  # at most ``buckets`` rows
        some.repartition("_bucket").drop("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_address").parquet(f"{folder}/data/{name}")
        written += new.count()
        lists.append(found.select(F.lit(name).alias("table"), F.lit(df.schema.json()).alias("schema"), "bucket", "rows", "address"))
        if found.isEmpty():  # a table without rows is there all the same
            lists.append(spark.createDataFrame([(name, df.schema.json(), -1, 0, "")], "table string, schema string, bucket int, rows long, address string"))
    whole = lists[0]
    for one in lists[1:]:
        whole = whole.union(one)
    whole.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/_g={number}")
    return number, written


def restore(spark: SparkSession, folder: str, name: str, generation: int | None = None) -> DataFrame:
    """A table as a generation (the newest by default) has it; an error if it is not in it."""
    generation = max(generations(spark, folder), default=0) if generation is None else generation
    mine = _manifests(spark, folder).where((F.col("_g") == generation) & (F.col("table") == name)).select("schema", "address").collect()  # a row a bucket
    if not mine:
        raise ValueError(f"generation {generation} has no table {name}")
    schema = StructType.fromJson(json.loads(mine[0]["schema"]))
    paths = [f"{folder}/data/{name}/_address={r['address']}" for r in mine if r["address"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def verify(spark: SparkSession, folder: str, generation: int | None = None) -> DataFrame:
    """(table, bucket, problem) of every bucket of a generation that is missing or does not hold what its address says."""
    generation = max(generations(spark, folder), default=0) if generation is None else generation
    listed = _manifests(spark, folder).where((F.col("_g") == generation) & (F.col("address") != ""))
    problems = spark.createDataFrame([], "table string, bucket int, problem string")
    for r in listed.groupBy("table").agg(F.min("schema").alias("schema")).collect():  # a row a table
        mine = listed.where(F.col("table") == r["table"])
        schema = StructType.fromJson(json.loads(r["schema"]))
        try:
            held = spark.read.schema(schema.add("_address", "string")).option("basePath", f"{folder}/data/{r['table']}").parquet(f"{folder}/data/{r['table']}")
        except AnalysisException:
            held = spark.createDataFrame([], schema)
        held = held.join(F.broadcast(mine.select(F.col("address").alias("_address"), F.col("bucket").alias("_bucket"))), "_address")
        now = _addresses(held, schema.names[:-1]).select("bucket", F.col("address").alias("now"), F.col("rows").alias("n"))
        both = mine.join(now, "bucket", "left").where(~F.col("now").eqNullSafe(F.col("address")))
        said = F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("n") != F.col("rows"), F.lit("other number of rows")).otherwise(F.lit("other content"))
        problems = problems.union(both.select("table", "bucket", said.alias("problem")))
    return problems
