import random
import re

import numpy as np
import pytest

from sextant.llm import minhash as M


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(texts):
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(sets[i]), root(i)) for i in range(len(texts))]


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 5)))
    texts = [None, "", " \n\t", "One", "one", "two words", "Two\tWords ", "É é", "é é", "a b c d e", "a b c d e f", "A b\nc d e"]
    for _ in range(25):
        base = [word() for _ in range(r.choice((6, 12, 40, 150, 400)))]
        for _ in range(r.randrange(1, 14)):  # near copies of which only some pairs are links
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(copy) // 40)):
                k = r.randrange(len(copy))
                copy[k : k + 1] = r.choice(([], [word()], [copy[k], word()]))
            texts.append(r.choice((" ", "  ", "\n")).join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    chain = [word() for _ in range(200)]
    for step in range(40):  # each links to the next, far ones don't
        chain[(step * 7) % 200] = word()
        texts.append(" ".join(chain))
    r.shuffle(texts)
    return texts


def test_sets_match_plain_ones():
    texts = corpus() + ["x " * 5000, "\x85 \xa0 a\x1cb", "a\x0bb\x0cc\rd e f", "word " * 3 + "😀"]
    sets, sizes = M.shingle_sets(texts)
    assert sizes.tolist() == [len(plain_set(t)) for t in texts]
    cuts = np.split(sets, np.cumsum(sizes)[:-1])
    for i in range(0, len(texts), 7):
        for j in range(len(texts)):
            assert len(np.intersect1d(cuts[i], cuts[j])) == len(plain_set(texts[i]) & plain_set(texts[j]))
    alone = [M.shingle_sets([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, cuts))


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        both, left = r.integers(0, 2**63, 300, np.uint64), r.integers(0, 2**63, 60, np.uint64)
        a, b = np.unique(np.concatenate([both, left])), np.unique(both)
        s = M.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((s[0] == s[1]).mean() - len(b) / len(a))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.045


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 2), (3, 3)])
def test_components_match_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(M, "BLOCK", block)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, id long").repartition(5)
    got = {r.doc_id: r for r in M.near_duplicates(df).collect()}
    want = plain_components(texts)
    assert len(got) == len(texts)
    for i, (n, c) in enumerate(want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, c == i), (i, got[i], n, c)


def test_block_finds_links_apart_from_the_smallest():
    r = random.Random(4)
    words = [str(r.random()) for _ in range(60)]
    other = [str(r.random()) for _ in range(60)]
    near = other[:-1] + ["x"]
    links = M.joins_in_block(np.array([1, 5, 9]), np.array([1, 5, 9]), [" ".join(w) for w in (words, other, near)])
    assert links == [(5, 9)]
    assert M.joins_in_block(np.array([5, 9]), np.array([5, 5]), [" ".join(w) for w in (other, near)]) == []


def test_path_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (5000, 4000)]
    got = {r.node: r.component for r in M.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)} | {5000: 4000, 4000: 4000}


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f")] * 3 + [(None, "a b c d e f"), (None, None), (4, None), (None, "q r s t u v")]
    got = sorted(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id == 1] == [(1, 1, True)] * 3
    assert sorted([(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None], key=str) == sorted([(2, 1, False), (0, None, True), (2, None, True)], key=str)
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = "a b c d e f", "k l m n o p", "u v w x y z"
    rows = [(9, a), (9, b), (9, None), (3, b), (5, a), (7, c), (7, c), (None, a), (None, None), (8, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(9, 2, 3, False), (9, 2, 3, False), (9, 0, 3, False), (3, 2, 3, True), (5, 2, 3, False), (7, 2, 7, True), (7, 2, 7, True), (None, 2, 3, False), (None, 0, None, True), (8, 0, 8, True)]
    assert got == sorted(want, key=str)


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 60)
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in M.near_duplicates(df).collect()}
    assert got == {i: c for i, (_, c) in enumerate(plain_components(texts))}
