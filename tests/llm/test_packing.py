import random
from collections import defaultdict

import pandas as pd
import pytest

from sextant.llm import packing as P


def plainly(rows, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []  # [residual, sources, clusters]
    for i in sorted(range(len(rows)), key=lambda i: -(rows[i][0] % capacity)):
        length, source, cluster = rows[i]
        for p in range(length // capacity):
            out.append((i, p, len(bins)))
            bins.append([0, set(), set()])
        rest = length % capacity
        if rest:
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= rest and b[0] and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([capacity, set(), set()])
            bins[k][0] -= rest
            bins[k][1].add(source)
            bins[k][2].add(cluster)
            out.append((i, length // capacity, k))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_same_bins_as_looking_at_all(seed):
    r = random.Random(seed)
    rows = [(r.choice((r.randrange(1, 400), r.randrange(1, 30), 64)), r.choice(("hot", "hot", *"abcdefghijklmnop", None)), r.choice((1, 1, *range(40), None))) for _ in range(700)]
    got = P.pack_group(pd.DataFrame(rows, columns=["length", "source", "cluster"]).astype({"cluster": "Int64"}), 100)
    assert [(i, p, b) for i, p, _, _, b, _ in got] == plainly(rows, 100)


def check(rows, packed, capacity):
    bins, per_doc = defaultdict(list), defaultdict(list)
    for r in packed:
        if r.length:
            bins[r.bin_id].append(r)
            per_doc[r.doc_id].append(r)
        else:
            assert r.bin_id is None
    by_id = {i: (n, s, c) for i, n, s, c in rows}
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert at <= capacity
        for k in (1, 2):
            held = [by_id[r.doc_id][k] for r in rs if by_id[r.doc_id][k] is not None]
            assert len(held) == len(set(held))
    for i, (n, _, _) in by_id.items():
        copies = {r.copy for r in packed if r.doc_id == i}
        assert sum(r.length for r in per_doc[i]) == (n or 0) * len(copies)
    return bins


def test_table(spark):
    r = random.Random(9)
    rows = [(i, r.choice((0, None, r.randrange(1, 300))), r.choice(("hot", "hot", "a", "b", None)), r.choice((7, 7, i, None))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, n long, source string, cluster long").repartition(4)
    import pyspark.sql.functions as F

    packed = P.best_fit(df, "doc_id", F.col("n"), F.col("source"), F.col("cluster"), 100, 128).collect()
    assert check(rows, packed, 100)
    assert {r.doc_id for r in packed} == set(range(600))
    again = P.best_fit(df.repartition(7), "doc_id", F.col("n"), F.col("source"), F.col("cluster"), 100, 128).collect()
    assert sorted(map(tuple, packed), key=str) == sorted(map(tuple, again), key=str)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x" * 10, "s")] * 500 + [(None, "y", None)] * 3, "doc_id long, text string, source string")
    rows = P.pack_documents(df).collect()
    assert len(rows) == 503 and {r.copy for r in rows if r.doc_id == 1} == set(range(500))
    assert len({r.bin_id for r in rows if r.doc_id == 1}) == 500  # one source, one cluster
    assert P.pack_documents(df.limit(0)).count() == 0


def test_query(spark, tmp_path):
    texts = [None, "", "é" * 5000, "a" * 8192, "a" * 8193, *("word " * (i % 50) for i in range(300))]
    spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, len((t or "").encode()), f"src{i % 3}", t) for i, t in enumerate(texts)]
    check(rows, P.op1_packing(spark, str(tmp_path)).collect(), P.CAPACITY)
