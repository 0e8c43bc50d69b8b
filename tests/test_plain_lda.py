"""PlainLDA against plain loops of batch variational LDA."""

import math
import random

import numpy as np
import pytest

from sextant.operators import topics as T


def digamma(x):
    out = 0.0
    while x < 50:
        out, x = out - 1 / x, x + 1
    return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)


def document(bag, b, k):
    """Weights of a document's topics."""
    mine = [1.0] * k
    for _ in range(100):
        e = [math.exp(digamma(x)) for x in mine]
        new = [1 / k] * k
        for w, n in bag.items():
            mass = sum(e[z] * b[w][z] for z in range(k))
            for z in range(k):
                new[z] += n * e[z] * b[w][z] / mass
        rests = sum(abs(x - y) for x, y in zip(new, mine)) / k < 1e-3
        mine = new
        if rests:
            break
    return mine


def plain(texts, k, seed, iterations):
    bags = [{w: t.split().count(w) for w in set(t.split())} for t in texts]
    cf = {w: sum(x.get(w, 0) for x in bags) for x in bags for w in x}
    vocabulary = sorted(cf, key=lambda w: (-cf[w], w))
    weights = dict(zip(vocabulary, np.random.default_rng(seed).gamma(100.0, 0.01, (len(cf), k)).tolist()))
    for at in range(iterations + 1):
        totals = [digamma(sum(x[z] for x in weights.values())) for z in range(k)]
        b = {w: [math.exp(digamma(x[z]) - totals[z]) for z in range(k)] for w, x in weights.items()}
        found = [document(x, b, k) for x in bags]
        if at == iterations:
            return vocabulary, weights, bags, b, found
        weights = {w: [1 / k] * k for w in vocabulary}
        for bag, mine in zip(bags, found):
            e = [math.exp(digamma(x) - digamma(sum(mine))) for x in mine]
            for w, n in bag.items():
                mass = sum(e[z] * b[w][z] for z in range(k))
                for z in range(k):
                    weights[w][z] += n * e[z] * b[w][z] / mass


def bound(rows, prior):
    total = 0.0
    for row in rows:
        logs = [digamma(x) - digamma(sum(row)) for x in row]
        total += sum((prior - x) * y + math.lgamma(x) - math.lgamma(prior) for x, y in zip(row, logs)) + math.lgamma(prior * len(row)) - math.lgamma(sum(row))
    return total


@pytest.mark.parametrize(("k", "pieces", "words"), [(3, 1, 2_000_000), (3, 4, 30), (17, 3, 100)])
def test_against_plain_loops(spark, monkeypatch, k, pieces, words):
    r = random.Random(5)
    names = [f"w{i:02d}" for i in range(60)]
    texts = [" ".join(r.choices(names[20 * (i % 3) : 20 * (i % 3) + 25], k=r.choice([1, 3, 12, 40]))) for i in range(70)]
    df = spark.createDataFrame([*enumerate(texts), (70, None), (71, ""), (72, "! a")], "id int, text string").repartition(pieces, "id")
    vocabulary, weights, bags, b, found = plain(texts, k, 7, 3)
    monkeypatch.setattr(T, "BLOCK_WORDS", words)
    monkeypatch.setattr(T, "RANGE", 16)
    model = T.PlainLDA(k, seed=7, iterations=3, vocabulary=T.ALL_TERMS).fit(df, "text")
    assert model.counts.vocabulary == vocabulary
    np.testing.assert_allclose(model.weights, [weights[w] for w in vocabulary], rtol=2e-4, atol=2e-4)
    got = {x.id: x.topics for x in model.transform(df, "text").collect()}
    assert sorted(got) == list(range(70))
    for i, mine in enumerate(found):
        np.testing.assert_allclose(got[i], np.array(mine) / sum(mine), atol=2e-4)
    es = [[math.exp(digamma(x) - digamma(sum(mine))) for x in mine] for mine in found]
    ll = sum(n * math.log(sum(e[z] * b[w][z] for z in range(k))) for bag, e in zip(bags, es) for w, n in bag.items())
    whole = ll + bound(found, 1 / k) + bound(np.array([weights[w] for w in vocabulary]).T.tolist(), 1 / k)
    assert math.isclose(model.perplexity(df, "text"), math.exp(-whole / sum(sum(x.values()) for x in bags)), rel_tol=1e-3)
    assert model.top_words(3) == [[vocabulary[i] for i in np.argsort(-w, kind="stable")[:3]] for w in model.weights.T]


def test_groups_of_documents_change_nothing(monkeypatch):
    r = np.random.default_rng(3)
    lengths = r.integers(1, 60, 80)
    places = np.concatenate([r.choice(200, n, replace=False) for n in lengths])
    counts, b = r.integers(1, 9, len(places)), r.random((200, 4))
    found = []
    for cells in (1, 500, 1_000_000):
        monkeypatch.setattr(T, "STEP_CELLS", cells)
        sums = np.zeros((200, 4))
        weights, ll = T._variational(lengths, places, counts, b, 0.25, sums)
        found.append(np.concatenate([weights.ravel(), sums.ravel(), [ll]]))
    np.testing.assert_allclose(found[0], found[1], rtol=1e-3)
    np.testing.assert_allclose(found[0], found[2], rtol=1e-3)
    np.testing.assert_allclose((b * sums).sum(1), np.bincount(places, counts, 200))
    x = np.array([0.01, 1 / 6, 0.9, 3.0, 70.0, 1e6])
    np.testing.assert_allclose(T._digamma(x), [digamma(v) for v in x], rtol=1e-7)
    np.testing.assert_allclose(T._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    model = T.PlainLDA(2, iterations=2).fit(df, "text")
    assert model.counts.vocabulary == [] and model.transform(df, "text").count() == 0
    assert model.transform(spark.createDataFrame([(1, "some words")], "id int, text string"), "text").count() == 0


def test_bounded_vocabulary_and_stop_words(spark):
    df = spark.createDataFrame([(1, "aa aa aa bb bb cc cc dd the the the the")], "id int, text string")
    assert T.PlainLDA(2, iterations=1, vocabulary=3, stop_words=["the"]).fit(df, "text").counts.vocabulary == ["aa", "bb", "cc"]


def test_too_many_terms_for_the_driver(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_CELLS", 6)
    with pytest.raises(ValueError, match="bound the vocabulary"):
        T.PlainLDA(2, iterations=1, vocabulary=T.ALL_TERMS).fit(spark.createDataFrame([("aa bb cc dd",)], "text string"), "text")
