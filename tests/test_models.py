"""The topic queries take whole documents and whole vocabularies."""

from sextant.operators import topics as T
from sextant.plans import models


def test_long_documents_and_rare_terms_get_topics(spark, tmp_path):
    long = " ".join(f"word{i % 300:03d}" for i in range(2400))  # beyond 1500 characters
    rare = " ".join(f"rare{i:04d}" for i in range(5000))  # more terms than 4096, each once
    rows = [(1, long, "en"), (2, " ".join(f"word{i:03d}" for i in range(100)), "de"), (3, rare, "en"), (4, " ".join(f"word{i:03d}" for i in range(100, 200)), "de"), (5, None, "en"), (6, "", "de"), (7, "rare4999", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = models.q_lda_topics(spark, str(tmp_path))
    assert sorted(r.doc_id for r in plain.collect()) == [1, 2, 3, 4, 7]  # those with terms
    labelled = models.q_plda_topics(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in labelled) == [1, 2, 4]  # rare terms fall under min_cf
    assert all(abs(sum(r.topics) - 1) < 1e-3 for r in labelled)


def test_whole_vocabulary_is_learnt(spark):
    df = spark.createDataFrame([(" ".join(f"t{i:06d}" for i in range(70_000)),)], "text string")
    assert len(T.PlainLDA(2, iterations=1, vocabulary=T.ALL_TERMS).fit(df, "text").counts.vocabulary) == 70_000
