"""Grouped operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: Sequence[str], null_keys: str = "drop"):
    """groupBy that leaves out rows with a null key unless null_keys is 'keep'."""
    return (df.dropna(subset=list(keys)) if null_keys == "drop" else df).groupBy(*keys)


def zero_sum(x: Column) -> Column:
    """A sum that is 0 where all is null."""
    return F.coalesce(F.sum(x), F.lit(0))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in order (make the order total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter("_n > 1").drop("_n")


def ordered_concat(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], sep: str = " ", name: str = "text") -> DataFrame:
    """Texts of a group joined in the order of their rows."""
    item = F.struct(*(F.col(c) for c in order), F.col(text).alias("_text"))
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"]), sep).alias(name))


def first_non_null(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """For each column the first value that isn't null, by order."""
    rank = F.struct(*(F.col(c) for c in order))
    return df.groupBy(*keys).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns))


def with_share(df: DataFrame, value: str, within: Sequence[str], name: str) -> DataFrame:
    """value over its total within groups; null where the total is 0."""
    total = F.sum(value).over(Window.partitionBy(*within))
    return df.withColumn(name, F.when(total != 0, F.col(value) / total))


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the n most frequent values of key; of equally frequent ones the smaller counts as more frequent."""
    top = df.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), F.asc(key)).limit(n)
    return df.join(F.broadcast(top.select(key)), key, "left_semi")  # n rows


def mean_vector(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(keys, dim, value): the weighted mean of vectors, in long form. One map-side sum for each key and dimension; rows of
    negative or null weight are an error, as is a group without weight."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    checked = F.when(w >= 0, w).otherwise(F.raise_error(F.lit("weights must not be negative or null")))
    long = df.select(*keys, checked.alias("_w"), F.posexplode(vector).alias("dim", "_x"))
    sums = long.groupBy(*keys, "dim").agg(F.sum(F.col("_w") * F.col("_x").cast("double")).alias("_wx"), F.sum("_w").alias("_sw"))
    total = F.when(F.col("_sw") > 0, F.col("_sw")).otherwise(F.raise_error(F.lit("a group has no weight")))
    return sums.select(*keys, "dim", (F.col("_wx") / total).alias("value"))


def as_vectors(long: DataFrame, keys: Sequence[str], name: str = "vector") -> DataFrame:
    """(keys, dim, value) rows as one array for each key; its length is that of the vectors."""
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias(name))


def pivot_share(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str], share: str) -> DataFrame:
    """One column for each of the values, 0 where a key has no row."""
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(share)).na.fill(0.0)


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(F.when(x.isNotNull(), w))


def mean_spread(x: Column) -> tuple[Column, Column, Column]:
    """Mean, sample deviation (0 for one value), number."""
    return F.avg(x), F.coalesce(F.stddev_samp(x), F.lit(0.0)), F.count(x)


def single_value(x: Column, none: str = "unlabeled", many: str = "mixed_weighting") -> Column:
    """The one distinct value of a group, or what stands for none or many. Two distinct values decide, so none is listed."""
    return F.when(F.min(x).isNull(), F.lit(none)).when(F.min(x) == F.max(x), F.min(x)).otherwise(F.lit(many))


def first_seen(df: DataFrame, value: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Distinct values, numbered from 0 by where they first occur. Few values: they are a label set."""
    seen = df.dropna(subset=[value]).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    return seen.withColumn(name, F.row_number().over(Window.orderBy("_at")) - 1).drop("_at")


def all_truthy(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Whether all non-null values of a text column read as booleans, and how many are true."""
    x = F.lower(F.trim(F.col(column)))
    return df.groupBy(*keys).agg(
        F.coalesce(F.bool_and(x.isin("true", "false", "1", "0", "yes", "no")), F.lit(False)).alias("is_bool"),
        F.count_if(x.isin("true", "1", "yes")).alias("n_true"),
    )


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by the order of a seeded hash of all columns: the same on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns)).limit(n)
