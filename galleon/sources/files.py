"""Sources and sinks: folder scans, delimited places, exports, packages, backups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ignored, safe_path
from ..operators.windows import top_n

# File endings by kind, and names that are never media.
PHOTO = "jpg jpeg png webp gif bmp tif tiff heic heif".split()
VIDEO = "mp4 mov m4v avi mkv webm mpg mpeg 3gp".split()
JUNK = r"(^|/)(\._[^/]*|[^/]*\.(part|tmp|crdownload))$"


def kind_of(path: Column) -> Column:
    """photo, video or null by the file's ending."""
    end = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(end.isin(*PHOTO), "photo").when(end.isin(*VIDEO), "video")


def scan(spark: SparkSession, folder: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, kind, size, modified) of media files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = files.withColumn("kind", kind_of(F.col("path"))).where(F.col("kind").isNotNull() & (F.col("size") > 0) & ~F.col("path").rlike(JUNK))
    return rows.where(~ignored(F.col("path"), ignore or [])).select("path", "kind", "size", "modified")


def places(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon, country) of a tab-separated gazetteer (columns 2, 5, 6 and 9)."""
    raw = spark.read.csv(path, sep="\t", quote="", header=False)
    return raw.select(F.col("_c1").alias("name"), F.col("_c4").cast("double").alias("lat"), F.col("_c5").cast("double").alias("lon"), F.col("_c8").alias("country"))


def nearest_place(points: DataFrame, cities: DataFrame, key: str, max_km: float = 40.0) -> DataFrame:
    """(key, name, km) of the nearest city within ``max_km``: equality on half-degree cells and their neighbours."""
    from ..functions.scalars import haversine_km

    cell = lambda c: F.floor(c * 2)
    rows = max(1, math.ceil(max_km / 55.0))
    # a degree of longitude shrinks with latitude: widen the search of cells there
    near = points.select(key, "lat", "lon", F.explode(F.sequence(F.lit(-rows), F.lit(rows))).alias("dy"), F.least(F.lit(60.0), F.ceil(F.lit(max_km / 55.0) / F.greatest(F.cos(F.radians("lat")), F.lit(0.01)))).cast("int").alias("reach"))
    near = near.select(key, "lat", "lon", (cell(F.col("lat")) + F.col("dy")).alias("cy"), F.explode(F.sequence(-F.col("reach"), F.col("reach"))).alias("dx"))
    near = near.select(key, "lat", "lon", "cy", F.pmod(cell(F.col("lon")) + F.col("dx") + 360, F.lit(720)).alias("cx")).distinct()
    city = cities.select("name", F.col("lat").alias("clat"), F.col("lon").alias("clon"), cell(F.col("lat")).alias("cy"), F.pmod(cell(F.col("lon")) + 360, F.lit(720)).alias("cx"))
    hit = near.join(city, ["cy", "cx"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon"))).where(F.col("km") <= max_km)
    return hit.groupBy(key).agg(F.min(F.struct("km", "name")).alias("x")).select(key, "x.name", "x.km")


def export_names(items: DataFrame, key: str, folder: list[str], name: str) -> DataFrame:
    """(key, path) below folders of sanitised parts; equal names in one folder are numbered."""
    stem, end = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 0)
    rows = items.withColumn("_dir", F.concat_ws("/", *(safe_path(F.col(c).cast("string")) for c in folder)))
    rows = top_n(rows, ["_dir", name], [F.asc(key)], 2**31 - 1, "_i")
    suffix = F.when(F.col("_i") > 1, F.concat(F.lit(" ("), F.col("_i").cast("string"), F.lit(")"))).otherwise("")
    return rows.select(key, F.concat(F.col("_dir"), F.lit("/"), stem, suffix, end).alias("path"))


def write_package(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as JSON lines and returns a manifest (table, n_rows, digest)."""
    lines = []
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        digest = F.coalesce(F.sum(F.crc32(F.to_json(F.struct(*sorted(df.columns))).cast("binary"))), F.lit(0))
        lines.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), digest.alias("digest")))
    out = lines[0]
    for x in lines[1:]:
        out = out.unionByName(x)
    return out


def read_package(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{name}")


def verify_backup(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of manifest rows (path, bytes, sha256) that the files (path, content) do not meet."""
    found = files.select("path", F.octet_length("content").alias("has"), F.sha2("content", 256).alias("sum"))
    j = manifest.join(found, "path", "full")
    problem = F.when(F.col("sum").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("has") != F.col("bytes"), "size").when(F.col("sum") != F.col("sha256"), "checksum")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def keep_last(log: DataFrame, key: str, n: int) -> DataFrame:
    """A ring buffer's content: the rows of the last ``n`` keys."""
    top = log.agg(F.max(key)).scalar()
    return log.where(F.col(key) > top - n)
