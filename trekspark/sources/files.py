"""Readers and writers of track, boundary, POI, segment and result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK_COLUMNS = ("track_id", "event_id", "t_s", "lon", "lat", "ele")
CLEANED = ("track_id", "scene", "event_id", "t_s", "lon", "lat", "ele", "speed_kmh", "hop_m", "stay", "region_id", "region_dist")
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_track_csv(spark: SparkSession, path: str, required: tuple = TRACK_COLUMNS, numbers: tuple = ("t_s", "lon", "lat", "ele", "speed_kmh")) -> DataFrame:
    """Points of CSV files whose header line names lon and lat: one string column per header name, ``numbers`` as double
    (bad values NULL). A file is UTF-8 if all its lines are, else GB18030. Lines with another number of fields
    than their file's header, and points without lon or lat, are dropped; a file that lacks a required column is an error."""
    raw = spark.read.option("encoding", "ISO-8859-1").text(path).select(F.col("_metadata.file_path").alias("file"), F.encode("value", "ISO-8859-1").alias("raw"))
    utf8 = F.decode("raw", "UTF-8").contains("�")
    kinds = raw.groupBy("file").agg((~F.bool_or(utf8)).alias("utf8"))
    text = F.when(F.col("utf8"), F.decode("raw", "UTF-8")).otherwise(F.decode("raw", "GB18030"))
    fields = F.transform(F.split(F.regexp_replace(text, "^﻿|\r$", ""), _COMMA), lambda x: F.regexp_replace(F.trim(x), '^"|"$', ""))
    lines = raw.join(kinds, "file").select("file", fields.alias("fields"))
    is_header = F.array_contains("fields", "lon") & F.array_contains("fields", "lat")
    headers = lines.where(is_header).groupBy("file").agg(F.first("fields").alias("header"))
    names = [r.header for r in headers.select("header").distinct().collect()]  # one row per layout of files
    for header in names:
        if missing := set(required) - set(header):
            raise ValueError(f"columns missing: {sorted(missing)}")
    rows = lines.where(~is_header).join(headers, "file").where(F.size("fields") == F.size("header"))
    every = sorted({x for header in names for x in header})
    at = lambda c: F.get("fields", F.array_position("header", c).cast("int") - 1)  # noqa: E731  the first of a name that is repeated, null where there is none
    value = lambda c: F.when(F.array_contains("header", c), at(c))
    out = rows.select(*((value(c).try_cast("double") if c in numbers else value(c)).alias(c) for c in every))
    return out.where("lon is not null and lat is not null") if every else out


_TRKPT = "struct<_lat: double, _lon: double, ele: double, time: timestamp>"
GPX_SCHEMA = f"trk array<struct<name: string, trkseg: array<struct<trkpt: array<{_TRKPT}>>>>>"


def read_gpx(spark: SparkSession, path: str, document_per_line: bool = False) -> DataFrame:
    """(track, lat, lon, ele, epoch_ms) of each GPX track point with a time; ele is 0 where missing, the track is its
    name or else the file's stem. A document is a file, or a line of one."""
    docs = spark.read.option("wholetext", not document_per_line).text(path).select("value", F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"))
    trk = docs.select("stem", F.explode(F.from_xml("value", GPX_SCHEMA).trk).alias("t"))
    points = trk.select(F.coalesce("t.name", "stem").alias("track"), F.explode(F.flatten(F.col("t.trkseg.trkpt"))).alias("p")).where("p.time is not null")
    return points.select("track", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.coalesce("p.ele", F.lit(0.0)).alias("ele"), F.unix_millis("p.time").alias("epoch_ms"))


def boundary_ring(doc: str) -> Column:
    """Outer ring (array of [lon, lat]) of a GeoJSON text's first feature, or of "lon,lat;lon,lat"; a line string is closed."""
    at = lambda path: F.from_json(F.get_json_object(doc, f"$.features[0].geometry.coordinates{path}"), "array<array<double>>")
    kind = F.get_json_object(doc, "$.features[0].geometry.type")
    line = at("")
    pairs = F.transform(F.split(doc, ";"), lambda p: F.transform(F.split(p, ","), lambda x: x.try_cast("double")))
    return F.when(kind == "Polygon", at("[0]")).when(kind == "MultiPolygon", at("[0][0]")).when(kind == "LineString", F.concat(line, F.slice(line, 1, 1))).when(kind.isNull(), pairs)


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, lon, lat): ring points of boundary documents, one document per line; name from the feature or the file's stem."""
    docs = spark.read.text(path).select("value", F.coalesce(F.get_json_object("value", "$.features[0].properties.name"), F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)).alias("name"))
    return docs.select("name", F.posexplode(boundary_ring("value")).alias("i", "p")).select("name", "i", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def read_poi(spark: SparkSession, path: str, scene: str = "scene") -> DataFrame:
    """Flat columns of POI documents: location is split, the city falls back to the province, nested parts stay JSON text."""
    schema = "id long, name string, type string, typecode string, address string, location string, pname string, cityname string, adname string, tel string, biz_ext map<string, string>, photos array<map<string, string>>, scene int"
    doc = spark.read.schema(schema).json(path)
    part = lambda k: F.get(F.split("location", ","), F.lit(k)).try_cast("double")
    city = F.coalesce(F.nullif(F.trim("cityname"), F.lit("")), "pname").alias("city")
    return doc.select(scene, F.col("id").alias("poi_id"), "name", "type", F.col("typecode").alias("type_code"), "address", part(0).alias("lon"), part(1).alias("lat"), city, F.col("adname").alias("district"), "tel", F.to_json("biz_ext").alias("biz_ext"), F.to_json("photos").alias("photos"))


def read_segments(spark: SparkSession, root: str, scenes: list, schema: str) -> tuple[DataFrame, list]:
    """Segment CSVs under ``root``/scene=... of some scenes with a scene column, and the scenes that are not there."""
    there = {str(r.scene) for r in spark.read.option("basePath", root).format("binaryFile").load(root).select("scene").distinct().collect()}
    found = [s for s in scenes if str(s) in there]
    table = spark.read.option("basePath", root).option("header", True).schema(f"{schema}, scene int").csv([f"{root}/scene={s}" for s in found]) if found else spark.createDataFrame([], f"{schema}, scene int")
    return table, [s for s in scenes if s not in found]


def read_clustered(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Clustered CSVs without a header, read by position, with the scene of their folder."""
    return spark.read.schema(f"{schema}, scene int").csv(root)


def scene_of(path: str) -> Column:
    """Scene of a file path: its stem without _cleaned or _clustered."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1), "_(cleaned|clustered)$", "")


def match_scene_file(boundaries: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file): the data file of each boundary: the same stem, else the same with a suffix word removed; ties to
    the smaller file name; NULL without one."""
    ranked = files.select("file", scene_of("file").alias("_key"), F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("_stem"))
    met = boundaries.join(ranked, F.col("name") == F.col("_key"), "left")
    return met.groupBy("name").agg(F.min(F.when(F.col("file").isNotNull(), F.struct((F.col("_stem") != F.col("name")).alias("other"), "file"))).alias("_b")).select("name", "_b.file")


ROW = "struct<target: int, seed: int, grp: string, setting: string, model: string, mae_min: double>"


def tidy_results(spark: SparkSession, path: str, setting: str, value: str = "mae_min") -> DataFrame:
    """(scene, seed, condition, value) of result documents in three shapes: {"rows": [...]}, [...] and {"seedX": [...]}, one
    document per line; other settings and rows without the value are left out."""
    doc = spark.read.text(path)
    many = lambda c: F.from_json(c, f"array<{ROW}>")
    by_seed = F.flatten(F.map_values(F.from_json("value", f"map<string, array<{ROW}>>")))
    rows = F.when(F.ltrim("value").startswith("["), many(F.col("value"))).when(F.get_json_object("value", "$.rows").isNotNull(), many(F.get_json_object("value", "$.rows"))).otherwise(by_seed)
    r = doc.select(F.explode(rows).alias("r")).select("r.*").where((F.col("setting") == setting) & F.col(value).isNotNull())
    return r.select(F.col("target").alias("scene"), "seed", F.col("grp").alias("condition"), F.col(value).alias("value"))


def write_cleaned(points: DataFrame, path: str, columns: tuple = CLEANED) -> None:
    """The cleaned table as CSV with a header, a folder per scene; columns that are not there are NULL; an empty table writes a header."""
    have = [F.col(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in columns]
    out = points.select(*have)
    (out.write.partitionBy("scene") if out.head(1) else out.coalesce(1).write).option("header", True).csv(path)


def tracks_to_geojson(points: DataFrame) -> DataFrame:
    """(track_id, n, mean_ele, mean_kmh, stop_ratio, feature): one LineString feature, as JSON text, per track of two points or more."""
    g = points.groupBy("track_id").agg(F.count("*").alias("n"), F.avg("ele").alias("mean_ele"), F.avg("speed_kmh").alias("mean_kmh"), F.avg((F.col("speed_kmh") <= 1).cast("double")).alias("stop_ratio"), F.sort_array(F.collect_list(F.struct("t_s", "event_id", "lon", "lat"))).alias("_p")).where("n >= 2")
    line = F.struct(F.lit("LineString").alias("type"), F.transform("_p", lambda x: F.array(x.lon, x.lat)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), F.struct("track_id", "n", "mean_ele", "mean_kmh", "stop_ratio").alias("properties")))
    return g.select("track_id", "n", "mean_ele", "mean_kmh", "stop_ratio", feature.alias("feature"))


def write_results(results: DataFrame, path: str, done: DataFrame | None = None, keys: tuple = ("target", "seed")) -> None:
    """Result rows in a folder per key, as Parquet; keys of ``done`` are kept as they are, only missing ones are written."""
    new = results if done is None else results.join(done.select(*keys).distinct(), list(keys), "left_anti")
    new.write.mode("append").partitionBy(*keys).parquet(path)


def first_of(frames: list[DataFrame]) -> DataFrame:
    """Tables one after another."""
    return reduce(DataFrame.unionByName, frames)


def numbered(points: DataFrame) -> DataFrame:
    """``points`` with k: their place in the track, by time and event."""
    return points.withColumn("k", F.row_number().over(Window.partitionBy("track_id").orderBy("t_s", "event_id")))
