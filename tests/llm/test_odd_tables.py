"""Columns of clashing names, nulls in every column, and long texts, for the operators that read a table of texts."""

import pytest

from sextant.llm import ann, bpe, html, minhash, packing, pii, tokcount, toxicity

NAMES = "id key host url2 texts around nodes hits bands bucket hub n component a b text_a copy bin piece score predicted ids bytes cell base added shard slot at sub".split()


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "a b c d e f", "a b c d e f", "mail x@y.org now", "w" * 150_000, "long " * 30_000]
    rows = [(i, t, "s", *(None if i % 2 else "z" for _ in NAMES)) for i, t in enumerate(texts)] + [(None, None, None, *(None for _ in NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)).repartition(3)


def test_every_row_comes_back(spark, odd):
    n = odd.count()
    assert minhash.near_duplicates(odd).count() == n
    assert bpe.encode_table(odd, "doc_id", "text").count() == n
    assert tokcount.token_counts(odd, "doc_id", "text").count() == n
    w = pii.train(odd)
    assert pii.spans_table(odd, "doc_id", "text", w).count() == n
    masked = pii.mask_table(odd, "text", w)
    assert masked.columns == odd.columns and masked.count() == n
    model = toxicity.fit(odd, spark.createDataFrame([(2, 1), (4, 0), (5, 0)], "doc_id long, toxic int"))
    scored = toxicity.score_table(odd, "text", model)
    assert scored.count() == n and set(scored.columns) == set(odd.columns)
    packed = packing.pack_documents(odd).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in odd.collect()}
    pages = html.main_text(odd.withColumnRenamed("text", "html"), "doc_id", "host", "html")
    assert pages.count() == n and pages.columns == ["doc_id", "host", "text", "n_chars"]


def test_equal_texts_are_one_group(odd):
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(odd).collect() if r.doc_id is not None}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def test_neighbours_beside_other_columns(spark):
    df = spark.createDataFrame([(i * 50, [float(i), 1.0], "x", "y", None) for i in range(4)] + [(None, None, None, None, None)], "vec_id long, embedding array<float>, id string, v string, block string")
    assert ann.search(df, "vec_id", "embedding", lambda i: i % 50 == 0).count() == 12
