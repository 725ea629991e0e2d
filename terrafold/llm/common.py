"""Helpers that the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.session import checkpoint_folder

#: A word is a run of characters other than ASCII white space.
WORD = r"[^ \t\n\x0B\f\r]+"
SPACE = r"[ \t\n\x0B\f\r]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines see: spark.checkpoint.dir, or a new one where that is unset and Spark runs on this machine alone."""
    return checkpoint_folder(spark)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: lost executors lose nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
