"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package, and have a checkpoint folder.

    The folder is the one the session names in spark.checkpoint.dir. Where that is unset, a local run (tests) takes a
    temporary one; on a cluster, where executors wouldn't share it, that is an error.
    """
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in known.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame, most_files: int | None = None) -> DataFrame:
    """A reliable checkpoint of df: lineage ends in the shared folder, so a lost executor costs one reread. most_files: where
    df is no larger than something of so many partitions, more files than that would only be small ones."""
    prepare(df.sparkSession)
    return (df.coalesce(most_files) if most_files else df).checkpoint(eager=True)


#: Bytes that go to Python in a batch (a longer row makes a batch of its own). Texts can be long: Spark's default of 10,000 rows
#: or 64 MB is held several times over while it is worked on.
BATCH_BYTES = 4 << 20
BATCH_SETTINGS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches bounded by bytes, unless the session sets a bound of its own, of bytes or of rows."""
    prepare(df.sparkSession)
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    if not any(conf.contains(name) for name in BATCH_SETTINGS):
        df.sparkSession.conf.set(BATCH_SETTINGS[0], BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def words_pattern() -> str:
    """Words are runs of anything but ASCII white space."""
    return r"[^\x20\x09-\x0D]+"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Numbers that expand() holds in one array.
EXPANDED_AT_ONCE = 100_000


def expand(df: DataFrame, n: str, name: str) -> DataFrame:
    """A row for each number from 0 to below the column n, in `name`; in parts, so that a large n needs no large array."""
    first = F.col("_part") * EXPANDED_AT_ONCE
    parts = df.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / EXPANDED_AT_ONCE))))
    return parts.withColumn(name, F.explode(F.sequence(first, F.least(first + EXPANDED_AT_ONCE, F.col(n)) - 1))).drop("_part")
