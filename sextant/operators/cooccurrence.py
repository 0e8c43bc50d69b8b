"""Term counts, co-occurrence in documents and topic coherence, in long form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..functions.vectors import npmi


def term_counts(df: DataFrame, doc: str, text: str, min_cf: int = 1, rm_top: int = 0, stop_words: Sequence[str] = ()) -> DataFrame:
    """(doc, term, n): counts of the terms that occur min_cf times or more, without the rm_top most frequent ones (of equally
    frequent terms the smaller is the more frequent) and without stop words."""
    words = df.select(doc, F.explode(terms(F.col(text))).alias("term"))
    if stop_words:
        words = words.filter(~F.col("term").isin([w.lower() for w in stop_words]))
    counts = words.groupBy(doc, "term").agg(F.count("*").alias("n"))
    if min_cf <= 1 and not rm_top:
        return counts
    vocabulary = counts.groupBy("term").agg(F.sum("n").alias("cf")).filter(F.col("cf") >= min_cf)
    counts = counts.join(vocabulary.select("term"), "term", "left_semi")
    if rm_top:
        top = vocabulary.orderBy(F.desc("cf"), "term").limit(rm_top)
        counts = counts.join(F.broadcast(top.select("term")), "term", "left_anti")  # rm_top rows
    return counts.select(doc, "term", "n")


def corpus_top_terms(df: DataFrame, text: str, k: int) -> list[str]:
    """The k most frequent terms of all texts; of equally frequent ones the smaller first."""
    counts = df.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return [r.term for r in counts.orderBy(F.desc("n"), "term").limit(k).collect()]


def pair_npmi(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """(a, b, pair, df_a, df_b, value) of all pairs a < b of the given words, a short list such as a topic's top words.

    One pass: a document adds one to itself, to each of the words it holds and to each pair of these; map-side sums leave no
    more rows than there are pairs, and these become one map.
    """
    listed = sorted(set(words))
    mark = lambda a, b: F.concat_ws("\u0001", a, b)
    held = F.array_sort(F.array_intersect("t", F.array(*map(F.lit, listed))))
    pairs = F.flatten(F.transform(F.col("held"), lambda a: F.transform(F.filter(F.col("held"), lambda b: b >= a), lambda b: mark(a, b))))
    docs = df.select(terms(F.col(text)).alias("t")).filter(F.size("t") > 0).select(held.alias("held"))
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), pairs)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    every = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(listed) for b in listed[i + 1 :]))
    n = lambda k: F.coalesce(F.try_element_at(F.col("m"), k), F.lit(0).cast("long"))
    rows = table.select("m", F.explode(every).alias("p")).select("p.a", "p.b", n(mark(F.col("p.a"), F.col("p.b"))).alias("pair"), n(mark(F.col("p.a"), F.col("p.a"))).alias("df_a"), n(mark(F.col("p.b"), F.col("p.b"))).alias("df_b"), n(F.lit("")).alias("n_docs"))
    return rows.select("a", "b", "pair", "df_a", "df_b", npmi(F.col("pair"), F.col("df_a"), F.col("df_b"), F.col("n_docs")).alias("value"))


def context_coherence(pairs: DataFrame) -> tuple[float, int]:
    """Mean cosine of all pairs of context vectors, whose entries are max(NPMI, 0) and 1 on the diagonal, and the number of
    pairs. pairs: what pair_npmi gave, a matrix of a short list of words."""
    rows = pairs.select("a", "b", "value").collect()
    words = sorted({w for r in rows for w in (r.a, r.b)})
    place = {w: i for i, w in enumerate(words)}
    m = np.eye(len(words))
    for r in rows:
        m[place[r.a], place[r.b]] = m[place[r.b], place[r.a]] = max(r.value, 0.0)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = (m @ m.T)[np.triu_indices(len(words), 1)]
    return (float(cos.mean()) if len(cos) else 0.0), len(cos)


def top_terms(counts: DataFrame, keys: Sequence[str], k: int, weight: str = "n") -> DataFrame:
    """The k heaviest terms of each key, with rank; of equal ones the smaller first."""
    total = counts.groupBy(*keys, "term").agg(F.sum(weight).alias("weight"))
    w = Window.partitionBy(*keys).orderBy(F.desc("weight"), "term")
    return total.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def purity_entropy(counts: DataFrame, key: str, label: str, n: str) -> DataFrame:
    """Of each key the share of its largest label, and the entropy of its labels over the logarithm of their number."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(key))
    s = counts.withColumn("_p", p).groupBy(key).agg(F.max("_p").alias("purity"), F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.ln("_p")).otherwise(0.0)).alias("h"), F.count("*").alias("k"))
    return s.select(key, "purity", F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(0.0).alias("fragmentation"))
