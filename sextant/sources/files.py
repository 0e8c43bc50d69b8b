"""Tables from and to files."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Quoted multi-line CSV with a header. keep_empty: empty fields stay empty strings instead of null."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema:
        r = r.schema(schema)
    df = r.csv(path)
    if keep_empty:
        df = df.na.fill("")
    return require_columns(df, columns).select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def stop_words(spark: SparkSession, path: str) -> list[str]:
    """One word a line; none where the file is missing."""
    try:
        return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def union_tables(frames: Mapping[str, DataFrame], name: str = "country_code") -> DataFrame:
    """Frames of different columns under each other, with the key each came by."""
    out = None
    for key, df in frames.items():
        df = df.withColumn(name, F.lit(key))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames")
    return out


def suffixed(path: str, suffix: str, exists=os.path.exists) -> str:
    """path with _suffix before its extension where such a file exists, else path."""
    stem, dot, extension = path.rpartition(".")
    candidate = f"{stem}_{suffix}{dot}{extension}" if dot else f"{path}_{suffix}"
    return candidate if exists(candidate) else path


def data_dir(environ: Mapping[str, str], name: str = "DATA_DIR", default: str = "data") -> str:
    """A folder from the environment; drive paths of Windows as they are mounted below /mnt."""
    path = environ.get(name, "").strip() or default
    if len(path) > 2 and path[1] == ":" and path[0].isalpha():
        return f"/mnt/{path[0].lower()}/{path[2:].replace(chr(92), '/').strip('/')}"
    return path
