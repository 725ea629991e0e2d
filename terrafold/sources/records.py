"""JSON records with versions: constraints and ground truth, read by Spark, one file a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
_LISTS = ("must_join", "must_not_join", "same_object", "different_object")
_PAIRS = "array<array<string>>"


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    """path, list, name_a, name_b, pose (sixteen doubles, or null), error: a row for each pair of each file.

    A file whose version isn't VERSION, that isn't JSON or that has an unknown
    field has one row with an error and no pair; a pair without two names has a
    row with an error and the names that it has. A pair of must_join may be a list of two names or an
    object with a, b and pose.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path"))
    schema = f"version int, must_join array<string>, {', '.join(f'{k} {_PAIRS}' for k in _LISTS[1:])}, _bad string"
    r = files.select("path", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(F.lit("version"), *map(F.lit, _LISTS))).alias("unknown"))
    fault = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col("r.version").isNull(), "not a constraints file").when(F.col("r.version") != VERSION, F.concat(F.lit("version "), F.col("r.version").cast("string"), F.lit(f", not {VERSION}"))).when(F.size("unknown") > 0, F.concat(F.lit("unknown field "), F.array_join("unknown", ", ")))
    r = r.withColumn("error", fault)
    bad = r.where("error is not null").select("path", *[F.lit(None).cast("string").alias(c) for c in ("list", "name_a", "name_b")], F.lit(None).cast("array<double>").alias("pose"), "error")
    good = r.where("error is null")
    none = F.lit(None).cast("string")
    must = good.select("path", F.explode("r.must_join").alias("x"))
    pair, pinned = F.from_json("x", "array<string>"), F.from_json("x", "a string, b string, pose array<array<double>>")
    listed = F.startswith(F.ltrim("x"), F.lit("["))
    short = lambda a, b, n: F.when(a.isNull() | b.isNull() | (n > 2), "a pair has two names").otherwise(none)
    one, two = F.when(listed, F.get(pair, F.lit(0))).otherwise(pinned["a"]), F.when(listed, F.get(pair, F.lit(1))).otherwise(pinned["b"])
    must = must.select("path", F.lit("must_join").alias("list"), one.alias("name_a"), two.alias("name_b"), F.when(~listed, F.flatten(pinned["pose"])).alias("pose"), short(one, two, F.when(listed, F.size(pair)).otherwise(2)).alias("error"))
    name = lambda i: F.get("x", F.lit(i))
    rest = [good.select("path", F.lit(k).alias("list"), F.explode(f"r.{k}").alias("x")).select("path", "list", name(0).alias("name_a"), name(1).alias("name_b"), F.lit(None).cast("array<double>").alias("pose"), short(name(0), name(1), F.size("x")).alias("error")) for k in _LISTS[1:]]
    for x in rest:
        must = must.unionByName(x)
    return must.unionByName(bad)


def read_ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """poses(path, name, object, pose) and adjacency(path, a, b) of ground-truth files."""
    schema = "fragments map<string, struct<matrix: array<array<double>>>>, object_of map<string, string>, adjacency array<array<string>>"
    r = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", schema).alias("r"))
    f = r.select("path", "r.object_of", F.explode("r.fragments").alias("name", "f"))
    poses = f.select("path", "name", F.try_element_at("object_of", F.col("name")).alias("object"), F.slice(F.flatten("f.matrix"), 1, 12).alias("pose"))
    pairs = r.select("path", F.explode("r.adjacency").alias("p")).select("path", F.least(F.col("p")[0], F.col("p")[1]).alias("a"), F.greatest(F.col("p")[0], F.col("p")[1]).alias("b"))
    return poses, pairs


def merged_truth(spark: SparkSession, parts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """fragments(name, object, pose) and adjacency(a, b) of several objects' ground-truth files as one collection: each name begins with its object and _.

    Units and wall thickness have to be the same in all (or missing in all), else a
    ValueError names two of them.
    """
    fragments = adjacency = sizes = None
    for name, path in parts.items():
        own = lambda c: F.concat(F.lit(f"{name}_"), c)  # noqa: E731,B023
        poses, pairs = read_ground_truth(spark, path)
        f = poses.select(own("name").alias("name"), F.lit(name).alias("object"), "pose")
        p = pairs.select(F.least(own("a"), own("b")).alias("a"), F.greatest(own("a"), own("b")).alias("b"))
        head = spark.read.text(path, wholetext=True).select(F.from_json("value", "units string, wall_thickness double").alias("h")).select("h.units", "h.wall_thickness")
        fragments, adjacency, sizes = (f, p, head) if fragments is None else (fragments.unionByName(f), adjacency.unionByName(p), sizes.unionByName(head))
    two = sizes.distinct().take(2)
    if len(two) > 1:
        raise ValueError(f"{two[0]['units']}, wall {two[0]['wall_thickness']}, but {two[1]['units']}, wall {two[1]['wall_thickness']} elsewhere")
    return fragments, adjacency


def read_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    """stem, x, y, z: the points of a folder's files STEM_Surface_*.xyz, of several files together; further columns and lines without three numbers are passed over."""
    r = spark.read.option("pathGlobFilter", "*_Surface_*.xyz").text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.split(F.trim("value"), r"\s+").alias("w"))
    p = r.select(F.regexp_extract("file", r"^(.*?)_Surface_", 1).alias("stem"), *[F.get("w", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")])
    return p.where("x is not null and y is not null and z is not null")


def surface_stem(name: str) -> Column:
    """A mesh's name without the ending that its surface files don't have."""
    return F.regexp_replace(name, "(_Mesh_DS|_Mesh)$", "")


def input_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """name, file, size, mtime_ms of the mesh files of a folder."""
    from terrafold.sources.mesh import find_meshes

    files = spark.read.format("binaryFile").load(folder).select("path", F.unix_millis("modificationTime").alias("mtime_ms"))
    return find_meshes(spark, folder).join(files, "path").select("name", F.element_at(F.split("path", "/"), -1).alias("file"), "size", "mtime_ms")
