"""A match that is stored and used again: its tables as Parquet under a folder, with a head that says what they are.

Every save goes into a folder of its own, and its head is written last, so a job
that dies leaves the earlier state as it was. The newest head counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.poses import rigid_fault

FORMAT, VERSION = "terrafold-match", 1
#: Tables of a state; evidence, with a row for each candidate, may be missing.
TABLES = ("names", "candidates", "evidence")
_HEAD = "format string, version int, run string, saved_at timestamp, has array<string>, settings map<string, string>"


def save_state(path: str, tables: dict[str, DataFrame], settings: dict[str, str] | None = None) -> str:
    """Writes names(id, name), candidates(cid, a, b, pose, ..) and, if given, evidence(cid, ..); returns the name of the run."""
    missing, unknown = {"names", "candidates"} - set(tables), set(tables) - set(TABLES)
    if missing or unknown:
        raise ValueError(f"a state has no {', '.join(sorted(missing))}" if missing else f"a state has no table {', '.join(sorted(unknown))}")
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/runs/{run}/{name}")
    spark = tables["names"].sparkSession
    row = spark.createDataFrame([(FORMAT, VERSION, run, None, sorted(tables), dict(settings or {}))], _HEAD)
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/heads")
    return run


def state_faults(tables: dict[str, DataFrame]) -> DataFrame:
    """fault, row: what is wrong with a state's tables, and with which row: names and candidates that stand twice, candidates of unknown fragments or one fragment twice, poses that are no motions, evidence without its candidate and candidates without evidence."""
    names, cand = tables["names"], tables["candidates"]
    told = lambda df, text, key: df.select(F.lit(text).alias("fault"), F.col(key).cast("string").alias("row"))
    twice = lambda df, key: df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = names.select("id").distinct()
    ends = cand.select("cid", F.explode(F.array("a", "b")).alias("id"))
    # an anti join keeps null ids, which are unknown too
    out = told(twice(names, "id"), "an id stands twice", "id").unionByName(told(twice(names, "name"), "a name stands twice", "name")).unionByName(told(twice(cand, "cid"), "a candidate stands twice", "cid"))
    out = out.unionByName(told(ends.join(ids, "id", "left_anti").select("cid").distinct(), "a candidate of an unknown fragment", "cid"))
    out = out.unionByName(told(cand.where("a = b"), "a candidate of one fragment", "cid"))
    if "pose" in cand.columns:
        fault = F.when(F.size("pose") == 12, rigid_fault("pose")).otherwise("not twelve numbers")
        # exploded, not filtered: the expression is long, and a filter over it would be computed twice
        bad = cand.where("pose is not null").select("cid", F.explode(F.array_compact(F.array(fault))).alias("why"))
        out = out.unionByName(bad.select(F.concat(F.lit("a pose is no motion: "), "why").alias("fault"), F.col("cid").cast("string").alias("row")))
    if "evidence" in tables:
        e = tables["evidence"]
        out = out.unionByName(told(twice(e, "cid"), "evidence stands twice", "cid")).unionByName(told(e.join(cand.select("cid"), "cid", "left_anti"), "evidence of no candidate", "cid")).unionByName(told(cand.join(e.select("cid"), "cid", "left_anti"), "a candidate without evidence", "cid"))
    return out


def load_state(spark: SparkSession, path: str, names: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The newest state's tables and settings. A ValueError says why it can't be used: another format or version, damaged tables, or other fragments than names(name)."""
    try:
        heads = spark.read.parquet(f"{path}/heads")
    except Exception as e:
        raise ValueError(f"{path}: not a stored match") from e
    head = heads.orderBy(F.desc("saved_at"), "run").first() if {"format", "version", "run", "saved_at"} <= set(heads.columns) else None
    if head is None or head["format"] != FORMAT:
        raise ValueError(f"{path}: not a stored match")
    if head["version"] != VERSION:
        raise ValueError(f"{path}: version {head['version']}, and this reads {VERSION}; match the collection again")
    tables = {k: spark.read.parquet(f"{path}/runs/{head['run']}/{k}") for k in head["has"]}
    faults = state_faults(tables).take(3)
    if faults:
        raise ValueError(f"{path}: " + "; ".join(f"{r['fault']} ({r['row']})" for r in faults))
    if names is not None:
        mine, theirs = names.select("name"), tables["names"].select("name")
        other = mine.exceptAll(theirs).unionByName(theirs.exceptAll(mine)).take(3)
        if other:
            raise ValueError(f"{path}: made of other fragments ({', '.join(str(r['name']) for r in other)}); match the collection again")
    return tables, head["settings"]
