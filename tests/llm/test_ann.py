import math

import numpy as np

from sextant.llm import ann


def plainly(rows, is_query, k):
    ok = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v) or len(v) != 16:
            continue
        ok.setdefault(i, v)
    out = {}
    for q, a in ok.items():
        if is_query(q):
            a = np.array(a)
            scores = [(-(float((a * b).sum()) / (np.sqrt((b * b).sum()) * np.sqrt((a * a).sum()))), i) for i, b in ((i, np.array(v)) for i, v in ok.items()) if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(10, 16))
    rows = [(i, (centres[i % 10] + r.normal(size=16) * 0.8).astype(np.float32).tolist()) for i in range(3000)]
    same = r.normal(size=16).astype(np.float32).tolist()
    rows += [(3000 + i, same) for i in range(1000)]  # many equal vectors
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [float("inf")] + [1.0] * 15), (5250, [1.0] * 3), (None, same), (5300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in ann.search(df, "vec_id", "embedding", lambda i: i % 50 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    want = plainly(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    hit = total = 0
    score = {(q, i): s for q, nearest in plainly(rows, lambda i: i % 50 == 0, 4000).items() for i, s in nearest}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5] and q not in [f[1] for f in found]
        assert all(abs(s - score[q, i]) < 1e-12 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len({f[1] for f in found} & {i for i, _ in want[q]})
        total += 5
        if q >= 3000:
            assert [f[1] for f in found] == [i for i in range(3000, 3007) if i != q][:5]
    assert hit / total >= 0.9


def test_recall_beside_a_dense_group():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x[:800] = x[0] + 0.01 * r.normal(size=(800, 64))
    x = x[r.permutation(4000)]
    block = ann.Block(x, ann.choose_pivots(x[:1024]))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 4000, 40):
        ((rows, score),) = block.search(x[q : q + 1], 6)
        found = set(rows[np.argsort(-score, kind="stable")][:6].tolist()) - {q}
        hit += len(found & set(np.argsort(-(unit @ unit[q]))[1:6].tolist()))
    assert hit / 500 >= 0.95


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in ann.search(df, "vec_id", "embedding", lambda i: i % 50 == 0).collect()}
    assert got == {(0, 1): (50, 0.707106781), (0, 2): (3, -1.0), (50, 1): (0, 0.707106781), (50, 2): (3, -0.707106781)}
    assert ann.search(df.limit(0), "vec_id", "embedding", lambda i: i % 50 == 0).count() == 0


def test_files_give_the_footrule_distance(monkeypatch):
    monkeypatch.setattr(ann, "PREFIX", 6)
    r = np.random.default_rng(1)
    x, pivots = r.normal(size=(50, 8)), r.normal(size=(20, 8))
    pivots /= np.linalg.norm(pivots, axis=1)[:, None]
    block = ann.Block(x, pivots)
    near = block.nearest(x)
    assert all(near[i].tolist() == np.argsort(-(pivots @ x[i]))[:6].tolist() for i in range(50))
    for p in range(20):
        assert set(block.rows[block.begin[p] : block.begin[p + 1]].tolist()) == {i for i in range(50) if p in near[i]}
    place = lambda i, p: near[i].tolist().index(p) if p in near[i] else 6
    saved = block.saved(near[:10])
    for q in range(10):
        for i in range(50):
            assert sum(abs(place(q, p) - place(i, p)) for p in range(20)) == 2 * sum(range(1, 7)) - 2 * saved[q, i]


def test_a_sixteenth_is_reranked_without_structure():
    r = np.random.default_rng(9)
    x = r.normal(size=(8000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    block, hit, queries = ann.Block(x, ann.choose_pivots(x[: ann.PIVOT_SAMPLE])), 0, range(0, 8000, 50)
    for q, (rows, score) in zip(queries, block.search(x[list(queries)], 6)):
        hit += len({i for i in rows[np.argsort(-score, kind="stable")][:6].tolist() if i != q} & set(np.argsort(-(unit @ unit[q]))[1:6].tolist()))
    assert hit / (5 * len(queries)) >= 0.9 and block.reranked / (len(queries) * len(x)) < 0.075


def test_each_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEXED_LENGTHS", 1)
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=(3, 3, 2)[i % 3]).tolist()) for i in range(120)] + [(200, [1.0] * 5)]
    got = {}
    for x in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", lambda i: i % 10 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    vectors = {i: np.array(v) for i, v in rows}
    cosine = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    for q in range(0, 120, 10):
        best = sorted((-cosine(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:5]
        assert [i for _, i in sorted(got[q])] == [i for _, i in best]
    assert 200 not in got


def test_rows_of_a_query_do_not_crowd_out_equal_vectors(spark):
    same, other = [1.0, 2.0, 0.0], [2.0, 0.0, 1.0]
    rows = [(0, same)] * 9 + [(7, same), (8, same), (9, same)] + [(50, other)] * 3 + [(51, other)] * 2 + [(52, other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for x in ann.search(df, "vec_id", "embedding", lambda i: i % 50 == 0, k=2).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, round(x.score, 9)))
    assert sorted(got[0]) == [(1, 7, 1.0), (2, 8, 1.0)]
    assert sorted(got[50]) == [(1, 51, 1.0), (2, 51, 1.0)]  # an entry for each row
