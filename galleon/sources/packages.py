"""Packages of a library: tables that refer to each other, exported, and imported under new keys.

A package is a folder of JSON lines, one table each, and a manifest with their rows, written last.
Importing goes through the tables in the order of their references.  References
are rewritten by the key maps of the tables before, rows that the library already has are recognised by what they
say (not by their keys), and all others get the next free keys, without holes.  Everything is joins on keys; no table is
sorted whole in one task.

The library itself is kept in versions: ``commit`` writes all tables of a version and then its
manifest, so an import is there as a whole or not at all.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.event_upkeep import dense_ids
from ..scratch import Scratch
from ..operators import windows

MANIFEST = "table string, schema string, rows long"
POLICIES = ("keep_both", "skip", "overwrite")


class Entity(NamedTuple):
    """A table's key (none for mere links), what its columns refer to, and the columns by which a row is recognised."""

    key: str | None
    refs: dict[str, str]
    same: tuple[str, ...]


#: The tables of a library.
LIBRARY = {
    "media": Entity("id", {}, ("content_hash",)),
    "people": Entity("id", {}, ("name",)),
    "faces": Entity("id", {"media_id": "media", "person_id": "people"}, ("media_id", "bbox")),
    "albums": Entity("id", {"cover_id": "media"}, ("name",)),
    "album_items": Entity(None, {"album_id": "albums", "media_id": "media"}, ("album_id", "media_id")),
    "edits": Entity(None, {"media_id": "media"}, ("media_id",)),
}


def in_order(graph: dict[str, Entity]) -> list[str]:
    """Table names, each after those it refers to; an error if they refer in a circle."""
    done: list[str] = []
    while len(done) < len(graph):
        ready = [n for n, e in graph.items() if n not in done and set(e.refs.values()) <= {*done}]
        if not ready:
            raise ValueError("references in a circle")
        done += ready
    return done


def _manifest(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    rows = [(n, df.schema.json(), df.count()) for n, df in tables.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes a package."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
    _manifest(spark, tables, folder)


def read(spark: SparkSession, folder: str, form: str = "json") -> dict[str, DataFrame]:
    """The tables of a package; an error unless every one is there with all its rows."""
    try:
        listed = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()  # a row a table
    except AnalysisException as error:
        raise ValueError(f"{folder} is no complete package") from error
    tables = {}
    for r in listed:
        tables[r["table"]] = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).format(form).load(f"{folder}/{r['table']}")
        if (n := tables[r["table"]].count()) != r["rows"]:
            raise ValueError(f"table {r['table']} has {n} of {r['rows']} rows")
    return tables


class Imported(NamedTuple):
    """The library's tables after an import; (old, new) of every table with keys; rows left out as what they refer to is not there."""

    tables: dict[str, DataFrame]
    keys: dict[str, DataFrame]
    dropped: dict[str, int]


def merge(package: dict[str, DataFrame], library: dict[str, DataFrame], policy: str = "skip", graph: dict[str, Entity] | None = None) -> Imported:
    """The library with a package in it.

    Of rows that the library has already, by ``skip`` its own stay, by ``overwrite`` the package's replace
    them under the library's key, and by ``keep_both`` both are there (links are never doubled).  Rows of a package that
    are recognised as the same are one row, that of the least key.  A null in the recognising columns is like nothing else.
    """
    graph = LIBRARY if graph is None else graph
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    spark = next(iter(library.values())).sparkSession
    tables, keep = Scratch(spark), Scratch(spark)
    out, keys, dropped = dict(library), {}, {}
    for name in in_order({n: e for n, e in graph.items() if n in library}):
        entity, mine = graph[name], library[name]
        if name not in package:
            continue
        rows = package[name].select(*mine.columns)
        for column, of in entity.refs.items():
            known = keys[of].select(F.col("old").alias("_old"), F.col("new").alias("_new")) if of in keys else spark.createDataFrame([], "_old long, _new long")
            rows = rows.join(known, F.col(column) == F.col("_old"), "left").where(F.col("_new").isNotNull() | F.col(column).isNull())
            rows = rows.withColumn(column, F.col("_new").cast(mine.schema[column].dataType)).drop("_old", "_new")
        rows = tables.write(rows.select(*mine.columns))
        dropped[name] = package[name].count() - rows.count()
        whole = F.lit(True)
        for c in entity.same:
            whole = whole & F.col(c).isNotNull()
        sign = F.when(whole, F.to_json(F.struct(*entity.same)))
        here = mine.where(whole).select(sign.alias("_sign"), *([F.col(entity.key).alias("_here")] if entity.key else [F.lit(0).alias("_here")])).groupBy("_sign").agg(F.min("_here").alias("_here"))
        rows = rows.withColumn("_sign", sign)
        if entity.key is None:
            fresh = windows.best(rows.where("_sign is not null"), ["_sign"], [-F.xxhash64(*mine.columns)])
            found = fresh.join(here, "_sign", "left")
            new = found.where("_here is null").select(*mine.columns)
            if policy == "overwrite":
                gone = found.where("_here is not null").select("_sign")
                new = new.union(found.where("_here is not null").select(*mine.columns))
                mine = mine.withColumn("_sign", sign).join(gone, "_sign", "left_anti").select(*mine.columns)
            out[name] = keep.write(mine.union(new))
            continue
        key = F.col(entity.key)
        if policy == "keep_both":
            rows, lead = rows.withColumn("_here", F.lit(None).cast("long")), F.lit(None).cast("long")
        else:
            rows = rows.join(here, "_sign", "left")
            lead = F.col("_lead")
            first = rows.where("_sign is not null").groupBy("_sign").agg(F.min(key).alias("_lead"))
            rows = rows.join(first, "_sign", "left")
        rows = tables.write(rows.withColumn("_lead", F.coalesce(lead, key)))
        top = mine.agg(F.max(entity.key)).first()[0] or 0
        born = dense_ids(rows.where(F.col("_here").isNull() & (F.col("_lead") == key)).select(key.alias("_lead")), ["_lead"], top + 1, "_new", tables)
        placed = tables.write(rows.join(born, "_lead", "left").withColumn("_key", F.coalesce("_here", "_new")))
        keys[name] = keep.write(placed.select(key.alias("old"), F.col("_key").alias("new")))
        leads = placed.where(F.col("_lead") == key)
        taken = leads if policy == "overwrite" else leads.where("_here is null")
        if policy == "overwrite":
            mine = mine.join(leads.where("_here is not null").select(F.col("_here").alias(entity.key)), entity.key, "left_anti")
        new = taken.select(*(F.col("_key").cast(mine.schema[c].dataType).alias(c) if c == entity.key else F.col(c) for c in library[name].columns))
        out[name] = keep.write(mine.select(*library[name].columns).union(new))
    tables.drop()
    return Imported(out, keys, dropped)


def commit(tables: dict[str, DataFrame], folder: str) -> int:
    """Writes all tables as the next version; the version counts from its manifest on."""
    spark = next(iter(tables.values())).sparkSession
    number = (latest(spark, folder) or 0) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v{number:06d}/{name}")
    _manifest(spark, {n: spark.read.schema(df.schema).parquet(f"{folder}/v{number:06d}/{n}") for n, df in tables.items()}, f"{folder}/v{number:06d}")
    return number


def latest(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version."""
    try:
        files = spark.read.schema(MANIFEST).parquet(f"{folder}/v*/manifest").select(F.regexp_extract(F.input_file_name(), r"/v(\d{6})/manifest/", 1).cast("int").alias("n"))
    except AnalysisException:
        return None
    return files.agg(F.max("n")).first()[0]


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest complete version."""
    number = latest(spark, folder)
    if number is None:
        raise ValueError(f"{folder} has no version")
    return read(spark, f"{folder}/v{number:06d}", "parquet")
