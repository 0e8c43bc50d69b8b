"""The pipeline against a version that does each stage plainly, in memory."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as C
from sextant.llm import pii, toxicity
from sextant.llm.packing import CAPACITY

from .test_minhash import plain_components
from .test_packing import plainly
from .test_pii import plainly as plain_spans

BAD = ["idjot", "skumm", "worthles"]


def corpus():
    r = random.Random(8)
    plain = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 7))) for _ in range(500)]
    texts, toxic = [], []
    for i in range(700):
        words = [r.choice(plain) for _ in range(r.choice((8, 40, 200)))]
        if i % 6 == 0:
            for k in range(2 + len(words) // 30):
                words[r.randrange(len(words))] = r.choice(BAD) + r.choice(("", "s"))
        if i % 9 == 1:
            words.insert(3, r.choice(("ann@mail.example.com", "10.20.30.40", "+1 (988) 555-2485", "4539148803436467")))
        texts.append(" ".join(words))
        toxic.append(int(i % 6 == 0))
    for i in range(1, 60, 2):
        words = texts[i].split()
        texts.append(" ".join(words[:-1]) if len(words) > 30 else texts[i])  # near or exact copies
        toxic.append(toxic[i])
    texts += [None, "", "x" * 20_000, "once " * 5000]
    return texts, toxic + [0, 0, 0, 0]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    texts, toxic = corpus()
    rows = [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), texts, toxic


def test_stages_match_plain_ones(spark, tables):
    base, texts, toxic = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    # toxicity
    model = toxicity.fit(docs, spark.read.parquet(f"{base}/labels.parquet"))
    clean = [i for i, t in enumerate(texts) if toxicity.Scorer(model).score([t])[0] < toxicity.THRESHOLD]
    a = C.drop_toxic(spark, docs, base).cache()
    assert a.columns == columns and sorted(r.doc_id for r in a.collect()) == clean
    assert sum(toxic[i] for i in clean) <= 0.1 * sum(toxic) and sum(1 - toxic[i] for i in clean) >= 0.97 * (len(toxic) - sum(toxic))
    # near-duplicates
    groups = plain_components([texts[i] for i in clean])
    kept = [i for k, i in enumerate(clean) if groups[k][1] == k]
    b = C.drop_near_duplicates(spark, a, base).cache()
    assert b.columns == columns and sorted(r.doc_id for r in b.collect()) == kept and len(kept) < len(clean)
    # personal data
    weights = pii.train(b)
    want = {i: pii.masked(texts[i], sum(pii.find_spans([texts[i]], weights)[0], [])) for i in kept}
    c = C.mask_personal_data(spark, b, base).cache()
    got = {r.doc_id: r for r in c.collect()}
    assert c.columns == columns and {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) and not plain_spans(r.text or "") for r in got.values())
    # packing: every group again, looking at every bin
    packed = C.pack(spark, c, base).collect()
    by_group = defaultdict(list)
    for r in packed:
        if r.bin_id is not None:
            by_group[r.bin_id >> 32].append(r)
    for rows in by_group.values():
        ids = sorted({r.doc_id for r in rows})
        plain = plainly([(len(got[i].text.encode()), got[i].source, got[i].text) for i in ids], CAPACITY)
        assert sorted((r.doc_id, r.piece, r.bin_id & 0xFFFFFFFF) for r in rows) == sorted((ids[k], p, n) for k, p, n in plain)
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(kept)


def test_run_is_the_stages_in_a_row(spark, tables):
    base, texts, _ = tables
    assert [name for name, _ in C.STAGES] == ["toxicity", "near_duplicates", "personal_data", "packing"]
    out = C.run(spark, base)
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, base)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_and_repeated_documents(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(None, "z", None, None, None), (2, None, "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    for _, stage in C.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert Counter(r.doc_id for r in docs.collect()) == {1: 1, None: 1, 2: 1}
    empty = spark.createDataFrame([], schema)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_different_texts_of_one_id_are_documents_of_their_own(spark, tmp_path):
    once, again = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, once, "en", "s", 19), (2, again, "en", "s", 19), (2, "u v w x y z 1 2 3 4", "en", "s", 19), (3, once, "en", "s", 19), (3, "5 6 7 8 9 10 11 12 13", "en", "s", 21), (4, None, "en", "s", None), (4, again, "en", "s", 19)]
    rows += [rows[2], (None, "alone", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = C.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[1], rows[2], rows[4], rows[5], rows[8]], key=str)
