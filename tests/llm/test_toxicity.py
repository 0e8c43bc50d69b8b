import random
import zlib

import numpy as np
import pytest

from sextant.llm import toxicity as T


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(T, "F32", np.float64)
    r = np.random.default_rng(0)
    tokens = T.token_inputs(["", *(f"word{i}" for i in range(9))])
    m = {k: v.astype(float) for k, v in T.start(3).items()}
    ids, mask = r.integers(0, 10, (5, 7)), np.ones((5, 7), bool)
    mask[0, 4:] = mask[1, 1:] = mask[2] = False
    y, w = np.array([1, 0, 1, 0, 1.0]), np.array([1, 2, 1, 0.5, 1.0])
    _, g = T.gradients(m, tokens, ids, mask, y, w)
    for k in m:
        flat, grad = m[k].reshape(-1), g[k].reshape(-1)
        for i in np.argsort(-abs(grad))[:4]:
            at, ends = flat[i], []
            for step in (1e-5, -1e-5):
                flat[i] = at + step
                ends.append(T.gradients(m, tokens, ids, mask, y, w)[0])
            flat[i] = at
            assert abs((ends[0] - ends[1]) / 2e-5 - grad[i]) < 1e-5 * max(1, abs(grad[i])), k


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 80, 81, 500])
def test_windows_overlap_and_cover(n):
    doc, first, size = T.windows(np.array([3, n, 100]))
    mine = [(f - 3, s) for d, f, s in zip(doc, first, size) if d == 1]
    assert set(range(n)) == {i for f, s in mine for i in range(f, f + s)}
    assert all(b[0] - a[0] == T.STRIDE < T.WINDOW for a, b in zip(mine, mine[1:])) and mine


def corpus(n, seed=1):
    r = random.Random(seed)
    plain = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    bad = ["idjot", "skumm", "worthles"]
    for i in range(n):
        toxic, words = i % 4 == 0, [r.choice(plain) for _ in range(r.choice((5, 40, 300)))]
        if toxic:
            for _ in range(1 + len(words) // 40):
                words[r.randrange(len(words))] = r.choice(bad) + r.choice(("", "s", "en"))
        yield " ".join(words), int(toxic)


def test_learns_and_holds_out(spark, tmp_path):
    rows = list(corpus(1200))
    docs = [(i, t) for i, (t, _) in enumerate(rows)] + [(5000, None), (5001, ""), (5002, rows[0][0])]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y) for i, (_, y) in enumerate(rows)] + [(0, 1), (1, None), (None, 1), (99_999, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in T.op5_toxicity(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [i for i in range(len(rows)) if got[i].held_out]
    assert np.mean([got[i].predicted == rows[i][1] for i in held]) > 0.93
    assert got[5000].score == got[5001].score and abs(got[5002].score - got[0].score) < 1e-5


def test_held_out_labels_have_no_influence(spark):
    rows = list(corpus(300))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    a = T.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    b = T.fit(docs, spark.createDataFrame([(i, 1 - y if out(i) else y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def test_no_labels_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 7.5), (2, None, None)], "doc_id long, text string, score double")
    model = T.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [(r.doc_id, r.score) for r in T.score_table(docs, "text", model).orderBy("doc_id").collect()] == [(1, 0.0), (2, 0.0)]
    assert T.score_table(docs.limit(0), "text", model).count() == 0


M64 = (1 << 64) - 1


def plain_mix(h):
    h = ((h ^ h >> 31) * 0x7FB5D329728EA185) & M64
    return h ^ h >> 29


def plain_score(m, text):
    """Windows, inputs, both recurrent layers, attention and the logistic unit by loops over single tokens and numbers."""
    factors = [int(x) for x in T.GRAM_FACTORS]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = (text or "").lower().split()

    def read(token):
        raw = b"\2" + token.strip(T.ENDS).encode() + b"\3"
        word = sum(plain_mix((b + (i + 1) * factors[0]) & M64) for i, b in enumerate(raw)) & M64
        grams = []
        for n in T.GRAM_SIZES:
            for i in range(len(raw) - n + 1):
                grams.append((plain_mix((n + sum((raw[i + k] + 1) * factors[k] for k in range(n))) & M64) >> 20) % T.GRAM_ROWS)
        mean = sum((m["gram"][g].astype(float) for g in grams), np.zeros(T.DIM)) / max(1, len(grams))
        return np.concatenate([m["word"][plain_mix(word) % T.WORD_ROWS].astype(float), mean])

    def pass_over(tokens, d):
        h, states, n = np.zeros(T.HIDDEN), [], T.HIDDEN
        for x in tokens:
            a, b = x @ m[f"w{d}"] + m[f"c{d}"], h @ m[f"u{d}"]
            z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            c = np.tanh(a[2 * n :] + r * b[2 * n :])
            h = z * h + (1 - z) * c
            states.append(h)
        return states

    best, first = None, 0
    while True:
        tokens = [read(w) for w in words[first : first + T.WINDOW]]
        states = [np.concatenate(p) for p in zip(pass_over(tokens, "f"), reversed(pass_over(tokens[::-1], "b")))]
        weight = [np.exp(np.tanh(s @ m["a"]) @ m["v"]) for s in states]
        pooled = sum((w * s for w, s in zip(weight, states)), np.zeros(2 * T.HIDDEN)) / max(sum(weight), 1e-9)
        logit = pooled @ m["o"] + m["bias"][0]
        best = logit if best is None else max(best, logit)
        if first + T.WINDOW >= len(words):
            return sigmoid(best)
        first += T.STRIDE


def test_scores_are_those_of_plain_loops(spark):
    rows = list(corpus(60))
    model = T.train([t for t, _ in rows], [y for _, y in rows], 0.25, epochs=2)
    texts = [None, "", " \n ", "Idjot!", "ärger ÄRGER (so)", *(t for t, _ in rows[:12]), " ".join(t for t, _ in rows[:8])]
    got = T.Scorer(model).score(texts)
    assert np.abs(got - np.array([plain_score(model, t) for t in texts])).max() < 1e-4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.score for r in T.score_table(docs, "text", model).collect()}
    assert max(abs(found[i] - got[i]) for i in found) < 1e-5


def test_long_texts_are_learnt_from(spark):
    """With a bound of 400 characters all texts are long; a stretch of each still tells the labels apart."""
    r = random.Random(4)
    rows = [(" ".join(r.choice(("idjot", "skumm") if i % 2 else ("la", "lu", "mi")) for _ in range(300)), i % 2) for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"), chars=400)
    assert "constant" not in model
    got = T.Scorer(model).score([t for t, _ in rows])
    assert all((s >= 0.3) == bool(y) for s, (_, y) in zip(got, rows))
