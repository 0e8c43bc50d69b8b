import random
import re

import numpy as np

from sextant.llm import pii

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plainly(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def samples(n, seed=5):
    r = random.Random(seed)
    bits = ["a@b.co", "x.y+z@mail-1.example.org", "1.2.3.4", "300.1.1.1", "4539148803436467", "4539 1488 0343 6467", "+1 (988) 555-2485", "+49 30 1234567", "@", ".", " ", "-", "+", "12", "word", "é", "\n", "0", "255.255.255.255.9", "Kö@x.de"]
    for _ in range(n):
        yield "".join(r.choice(bits) for _ in range(r.randrange(1, 25)))
        yield "".join(r.choice("ab@.-+ 0129()\n") for _ in range(r.randrange(60)))


def test_base_spans_match_plain_patterns():
    for text in samples(3000):
        assert pii.base_spans(text) == plainly(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@a" * 150_000, "+1" + " " * 300_000, "+1 " * 100_000, "password=" * 40_000, "password = " * 30_000, "=" * 300_000, "Dr. " * 80_000, "Dr. Xa1 " * 30_000, "4539148803436467 " * 15_000):
        pii.find_spans([text], pii.fit([]))


def exact_marginals(graph, w):
    import itertools

    unary = graph.x @ w["unary"]
    total = np.zeros_like(unary)
    for labels in itertools.product(range(pii.K), repeat=graph.n):
        s = sum(unary[i, a] for i, a in enumerate(labels))
        s += sum(w["chain"][labels[a], labels[b]] for a, b in graph.chain) + sum(w["skip"][labels[a], labels[b]] for a, b in graph.skip)
        for i, a in enumerate(labels):
            total[i, a] += np.exp(s)
    return total / total.sum(1, keepdims=True)


def test_messages_are_exact_on_trees_and_near_on_loops():
    r = np.random.default_rng(1)
    w = {"unary": r.normal(size=(3 * pii.N_TOKEN, pii.K)) * 0.3, "chain": r.normal(size=(pii.K, pii.K)) * 0.5}
    a = r.normal(size=(pii.K, pii.K)) * 0.5
    w["skip"] = a + a.T
    tree = pii.Graph(["12 a@b 77 word 9 word 5"])
    assert not len(tree.skip) and len(tree.chain) == 2
    np.testing.assert_allclose(pii.marginals(tree, w, 60), exact_marginals(tree, w), atol=1e-6)
    loop = pii.Graph(["12 a@b 77 word 12, a@b"])
    assert len(loop.skip) == 2
    np.testing.assert_allclose(pii.marginals(loop, w, 60), exact_marginals(loop, w), atol=0.08)


def test_repeats_agree_and_edges_stay_linear():
    many = pii.Graph(["555-0199-22 x " * 4000])
    assert len(many.skip) == 3999
    w = {"unary": np.zeros((3 * pii.N_TOKEN, pii.K)), "chain": np.zeros((pii.K, pii.K)), "skip": 3 * np.eye(pii.K)}
    w["unary"][2, 4] = 4.0  # a leading plus speaks for a phone number
    g = pii.Graph(["+15550199222 then 15550199222 again"])
    p = pii.marginals(g, w)
    assert p[1, 4] > 0.7  # only through its similar neighbour far away


def corpus():
    r = random.Random(2)
    for i in range(300):
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(30)]
        words.insert(5, r.choice([f"user{i}@mail{i % 7}.example.com", f"{i % 250}.2.3.{i % 200}", f"+1 (988) 555-{1000 + i}", "4.0", f"AKIA{i}XYZ", "2024"]))
        yield " ".join(words)


def test_added_spans(spark, tmp_path):
    texts = [None, "", "no data here", *corpus(), "ask user9 at user9@mail1.example.com or 15550199222", "x" * 70_000 + " 9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in pii.op10_pii(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        base = plainly(t or "")
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        spans = set(filter(None, rows[i].spans.split(",")))
        assert {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base} <= spans and len(spans) == len(base) + rows[i].n_added
    assert rows[2].spans == "" == rows[0].spans
    w = pii.train(df)
    again = {r.doc_id: r for r in pii.spans_table(df, "doc_id", "text", w).collect()}
    assert all(pii.joined([(pii.KINDS.index(s.kind), s.start, s.end) for s in r.base + r.added]) == rows[i].spans for i, r in again.items())
    clean = {r.doc_id: r.text for r in pii.mask_table(df, "text", w).collect()}
    assert clean[0] is None and clean[2] == "no data here"
    assert not any(plainly(t or "") for t in clean.values())
    assert pii.mask_table(df.limit(0), "text", w).count() == 0


def test_masks_overlaps_once():
    assert pii.masked("ab12345cd", [(2, 2, 5), (3, 4, 7)]) == "ab<CARD>cd"
    assert pii.fit([])["unary"].sum() == 0


def consistent(n, seed=3):
    """Passwords with a cue once and bare further on, beside as many words of the same shape that are none."""
    r = random.Random(seed)
    new = lambda: "".join(r.choice("bcdfgklm") + r.choice("aeiou") for _ in range(3)) + str(r.randrange(10, 99))
    for _ in range(n):
        words = [r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)] + [new() for _ in range(4)]
        r.shuffle(words)
        secret = new()
        yield " ".join([f"password = {secret}", *words, secret, *words[:3]]), secret


def test_what_is_linked_is_labelled_alike(spark):
    """A bare password looks like any other word with digits: only the skip edge to where its cue stands tells it."""
    w = pii.fit([t for t, _ in consistent(300)])
    texts, secrets = zip(*consistent(60, 8))
    found = pii.added_spans(list(texts), [pii.base_spans(t) for t in texts], w)
    places = [[m.start() for m in re.finditer(rf"\b{s}\b", t)] for t, s in zip(texts, secrets)]
    assert all(len(p) == 2 for p in places)
    assert sum([s for _, s, _ in f] == p for f, p in zip(found, places)) >= 48
    without = pii.added_spans(list(texts), [pii.base_spans(t) for t in texts], w | {"skip": np.zeros((pii.K, pii.K))})
    assert all(p[0] in [s for _, s, _ in f] for f, p in zip(without, places)) and not any(p[1] in [s for _, s, _ in f] for f, p in zip(without, places))


def test_secrets_and_names():
    r = random.Random(1)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    names = ["Meyer", "Moreau", "García", "Smith", "Ivanova"]
    texts = []
    for i in range(200):
        name = r.choice(names)
        texts.append(f"We met Dr. {name} in Room {i} on 12.4.{2000 + i % 20}. Then {name} left. " + r.choice([f'token = "{hexes()}"', f"password={hexes()[:18]}", "AKIA" + "".join(r.choice("ABCXYZ0123") for _ in range(16)), f"id {r.randrange(10**15)}"]) + " was read.")
    w = pii.fit(texts)
    text = 'Herr Okafor saw Okafor, said Okafor. Use api_key: "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" or password=09fca1b2c3d4e5f6a7 now, not 123456789012345 or Room 7.'
    (found,) = pii.added_spans([text], [pii.base_spans(text)], w)
    assert sorted((pii.LABELS[k], text[a:b]) for k, a, b in found) == [("name", "Okafor")] * 3 + [("secret", "09fca1b2c3d4e5f6a7"), ("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]
    assert pii.masked(text, found).startswith("Herr <NAME> saw <NAME>, said <NAME>.")


def test_a_secret_may_cover_a_base_span():
    known = pii._merged([(2, 10, 20), (3, 18, 25), (0, 40, 50)])
    assert known == ([10, 40], [25, 50])
    cases = [((0, 10), False), ((0, 11), True), ((25, 40), False), ((24, 30), True), ((41, 42), True), ((50, 60), False)]
    assert all(pii._touches(known, *span, False) == touches for span, touches in cases)
    assert not pii._touches(known, 8, 26, True) and not pii._touches(known, 10, 50, True) and pii._touches(known, 12, 26, True) and pii._touches(known, 8, 45, True)
    assert pii.joined([(4, 9, 12), (0, 3, 4), (2, 1, 2)]) == "email:3:4,card:1:2,secret:9:12"
