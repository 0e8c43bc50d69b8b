import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sextant.functions import dates as D
from sextant.functions import stats, text, vectors
from sextant.operators import aggs, joins, panel, regression, topics


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items())
    return spark.createDataFrame([tuple(v[1] for v in values.values())], schema).select(column).first()[0]


def day(s):
    return dt.date.fromisoformat(s)


def test_asof_against_pandas(spark):
    r = np.random.default_rng(0)
    left = pd.DataFrame({"g": r.choice(list("abcd"), 300), "t": pd.Timestamp("2020-01-01") + pd.to_timedelta(r.integers(0, 400, 300), "D"), "id": range(300)}).sort_values("t")
    right = pd.DataFrame({"g": r.choice(list("abc"), 40), "s": pd.Timestamp("2020-01-01") + pd.to_timedelta(r.permutation(400)[:40], "D"), "k": range(40)}).sort_values("s")
    want = pd.merge_asof(left, right, left_on="t", right_on="s", by="g").set_index("id")["k"]
    got = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["g"], "t", "s", ["k"], tie=["k"]).toPandas().set_index("id")["k"].reindex(want.index)
    assert got.fillna(-1).tolist() == want.fillna(-1).tolist()
    filled = joins.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["g"], "t", "s", ["k"], tie=["k"], fallback=True).toPandas().set_index("id")
    assert "d" not in set(filled["g"])
    first = right.sort_values("s").groupby("g").first()["k"]
    for i, row in filled.iterrows():
        expected = want[i] if not math.isnan(want[i]) else first[row["g"]]
        assert row["k"] == expected and (row["selection_method"] == "fallback_to_earliest") == math.isnan(want[i])


def test_asof_ties_nulls_and_exactness(spark):
    left = spark.createDataFrame([("a", day("2020-01-05"), 1), ("a", day("2020-01-05"), 1), ("a", None, 2), (None, day("2020-01-05"), 3)], "g string, t date, id int")
    right = spark.createDataFrame([("a", day("2020-01-05"), 1), ("a", day("2020-01-05"), 2), ("a", day("2020-01-01"), 9), ("a", None, 7)], "g string, s date, k int")
    got = sorted((r.id, r.k or 0) for r in joins.asof_join(left, right, ["g"], "t", "s", ["k"], tie=["k"]).collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert {r.k for r in joins.asof_join(left, right, ["g"], "t", "s", ["k"], tie=["k"], allow_exact=False).collect() if r.id == 1} == {9}


def test_group_null_keys_and_sums(spark):
    df = spark.createDataFrame([("a", None), (None, 1), ("a", None)], "k string, v int")
    rows = aggs.grouped(df, ["k"]).agg(aggs.zero_sum(F.col("v")).alias("s")).collect()
    assert [(r.k, r.s) for r in rows] == [("a", 0)]
    assert aggs.grouped(df, ["k"], "keep").count().count() == 2


def test_null_safe_and_validated_joins(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 5), ("x", 6)], "k string, v int").withColumnRenamed("v", "w")
    assert sorted((r.v, r.w) for r in joins.null_safe_join(a, b, ["k"]).collect()) == [(1, 5), (2, 6)]
    twice = spark.createDataFrame([("x", 1), ("x", 2)], "k string, v int")
    with pytest.raises(joins.CardinalityError):
        joins.validated_join(a, twice, ["k"], validate="many_to_one")
    assert set(joins.validated_join(twice, a, ["k"]).columns) == {"k", "v_left", "v_right"}
    with pytest.raises(KeyError):
        joins.require_matched(twice, a.filter("k is null"), ["k"])


def test_floor_days_and_midpoint(spark):
    later, earlier = dt.datetime(2020, 1, 10), dt.datetime(2020, 1, 1, 12)
    assert one(spark, D.floor_days(F.col("a"), F.col("b")), a=("timestamp", later), b=("timestamp", earlier)) == 8
    assert one(spark, D.floor_days(F.col("b"), F.col("a")), a=("timestamp", later), b=("timestamp", earlier)) == -9
    assert one(spark, D.midpoint(F.col("a"), F.col("b"), F.col("a")), a=("date", day("2020-01-01")), b=("date", day("2020-01-04"))) == dt.datetime(2020, 1, 2, 12)


@pytest.mark.parametrize("raw,want", [(" 2020-02-29 ", "2020-02-29"), ("2020-02-29T10:00:00Z", "2020-02-29"), ("2021-02-29", None), ("2020-1-1", None), ("x", None), (None, None), ("2020-01-01 rest", "2020-01-01")])
def test_iso_dates(spark, raw, want):
    got = one(spark, D.parse_iso_date(F.col("x")), x=("string", raw))
    assert got == (day(want) if want else None)


def test_text(spark):
    assert one(spark, text.tokens(F.col("x")), x=("string", "Žába½ a_1 — É")) == ["žába½", "a_1", "é"]
    assert one(spark, text.clean_text(F.col("x")), x=("string", " a \t b\n")) == "a b"
    assert one(spark, text.join_unique(F.col("x")), x=("array<string>", ["b", "", None, "a", "b"])) == "b | a"
    assert one(spark, text.safe_name(F.col("x")), x=("string", "/a b!!c_")) == "a_b_c"
    assert text.canonical_key("Saskaņa „X-1“") == "SASKANAX1" and text.canonical_key(None) == ""
    labels = spark.createDataFrame([("ANO 2011",), ("Zaļo",), (None,)], "x string")
    assert [r[0] for r in labels.select(text.canonical_label(F.col("x"))).collect()] == ["ANO2011", "ZALO", ""]


def test_distances(spark):
    p, q = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    v = {"p": ("array<double>", p), "q": ("array<double>", q)}
    a, b = F.col("p"), F.col("q")
    assert one(spark, vectors.js_distance(a, b), **v) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vectors.js_distance(a, a), **v) == 0.0
    assert one(spark, vectors.hellinger(a, b), **v) == pytest.approx(math.sqrt(0.5))
    assert one(spark, vectors.cosine(a, b), **v) == pytest.approx(0.5)
    assert one(spark, vectors.cosine(a, F.transform(b, lambda x: x * 0), 0.0), **v) == 0.0
    assert one(spark, vectors.argmax(F.col("p")), **v) == 0
    assert one(spark, vectors.clipped_normalized(F.transform(a, lambda x: x - 1)), **v) is None
    with pytest.raises(Exception, match="mass"):
        one(spark, vectors.require_mass(F.transform(a, lambda x: x * 0)), **v)
    assert spark.range(1).select(vectors.npmi(F.lit(0), F.lit(5), F.lit(5), F.lit(10)), vectors.npmi(F.lit(10), F.lit(10), F.lit(10), F.lit(10)), vectors.npmi(F.lit(5), F.lit(5), F.lit(5), F.lit(10))).first()[:] == (-1.0, 1.0, 1.0)


def test_weights(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("a", [0.0, 1.0], 3.0), ("b", [2.0, 2.0], 0.0)], "g string, v array<double>, w double")
    got = aggs.as_vectors(aggs.mean_vector(df.filter("g = 'a'"), ["g"], "v", F.col("w")), ["g"]).first()
    assert got.vector == [0.25, 0.75]
    with pytest.raises(Exception, match="no weight"):
        aggs.mean_vector(df, ["g"], "v", F.col("w")).collect()
    with pytest.raises(Exception, match="negative"):
        aggs.mean_vector(df, ["g"], "v", F.lit(-1.0)).collect()


def test_before_first_election(spark):
    left = spark.createDataFrame([("c", dt.datetime(2000, 1, 1)), ("c", dt.datetime(2010, 6, 1)), ("c", dt.datetime(2031, 1, 1))], "c string, at timestamp")
    e = spark.createDataFrame([("c", day(f"{y}-06-01")) for y in (2006, 2010, 2014)], "c string, election date")
    a, b, c = panel.election_cycle(left, e, ["c"], "at", "election").orderBy("at").collect()
    assert (a.election, a.electoral_cycle_progress, a.cycle_boundary_source) == (None, None, "observed_next_election")
    assert b.election == day("2010-06-01") and b.electoral_cycle_progress == 0.0 and b.cycle_length_days == 1461
    assert c.cycle_boundary_source == "imputed_country_median_cycle" and (c.electoral_cycle_progress, c.electoral_cycle_remaining) == (1.0, 0.0)


def test_student_t():
    assert stats.t_two_sided(-4.288250, 1957) == pytest.approx(1.888501e-05, rel=1e-5)
    for t in (0.1, 1.0, 3.7, 40.0):  # closed forms for 1 and 2 degrees of freedom
        assert stats.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-10)
        assert stats.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert stats.t_quantile(0.975, 1) == pytest.approx(12.706204736432095, abs=1e-8)


def test_least_squares_against_dense(spark):
    r = np.random.default_rng(2)
    n = 400
    pdf = pd.DataFrame({"x": r.normal(size=n), "z": r.normal(size=n) * 50 + 1000, "party": r.choice(list("abc"), n), "flag": r.random(n) > 0.5})
    pdf["country"] = np.where(pdf.party == "a", "A", "B")  # told by party: redundant
    pdf["y"] = 1 + 2 * pdf.x - 0.01 * pdf.z + (pdf.party == "b") * 3 + r.normal(size=n) * (1 + abs(pdf.x))
    pdf.loc[5, "y"] = None
    f = regression.fit_ols(spark.createDataFrame(pdf), "y", ["x", "z", "flag"], ["party", "country"])
    assert f.names == ["const", "x", "z", "flag", "FE_party_b", "FE_party_c"] and f.dropped == ["FE_country_B"] and f.n == n - 1
    d = pdf.dropna()
    x = np.column_stack([np.ones(len(d)), d.x, d.z, d.flag.astype(float), d.party == "b", d.party == "c"]).astype(float)
    y = d.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e, inv = y - x @ beta, np.linalg.inv(x.T @ x)
    hc1 = len(y) / (len(y) - 6) * inv @ (x.T * e**2) @ x @ inv
    np.testing.assert_allclose(f.beta, beta, rtol=1e-8)
    np.testing.assert_allclose(np.sqrt(np.diag(f.covariance)), np.sqrt(np.diag(hc1)), rtol=1e-6)
    assert f.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum()) and f.rmse == pytest.approx(math.sqrt(e @ e / (len(y) - 6)))
    classic = regression.fit_ols(spark.createDataFrame(pdf), "y", ["x", "z", "flag"], ["party", "country"], robust="classic")
    np.testing.assert_allclose(np.diag(classic.covariance), e @ e / (len(y) - 6) * np.diag(inv), rtol=1e-6)
    got = regression.with_fitted(spark.createDataFrame(pdf), f, ["x", "z", "flag"], ["party", "country"]).toPandas()
    np.testing.assert_allclose(got.residual.sum(), 0, atol=1e-6)
    negated = regression.fit_ols(spark.createDataFrame(pdf).withColumn("y", 1 - F.col("y")), "y", ["x", "z", "flag"], ["party", "country"])
    np.testing.assert_allclose(negated.beta[1:], -f.beta[1:], rtol=1e-7)
    assert "x" in f.report()


@pytest.mark.parametrize("few", [64, 100, 1000])
def test_interval_lookup_against_plain_loops(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_INTERVALS", few)
    r = np.random.default_rng(4)
    start = lambda: None if r.random() < 0.15 else day("2019-12-20") + dt.timedelta(int(r.integers(0, 700)))
    right = []
    for i in range(400):
        s = start()
        e = None if r.random() < 0.2 else (s or day("2020-02-01")) + dt.timedelta(int(r.integers(-3, 250)))
        right.append((str(r.choice(list("abc"))), s, e, int(p) if (p := r.integers(0, 4)) < 3 else None, i % 37))
    left = [(str(g) if g != "-" else None, start(), i) for i, g in enumerate(r.choice(list("aaaabcd-"), 500))] + [("a", day("0001-01-01"), 500), ("a", day("9999-12-31"), 501), ("a", day("9999-12-31"), 501)]
    want = []
    for g, at, i in left:
        pool = [x for x in right if x[0] == g and x[3] is not None]
        inside = [x for x in pool if at and (x[1] is None or at >= x[1]) and (x[2] is None or at <= x[2])]
        best = min(inside or pool, key=lambda x: (x[3], x[1] is None, -(x[1] or day("2020-01-01")).toordinal(), x[4]), default=None)
        want.append((i, best and best[4], bool(inside)))
    lefts, rights = spark.createDataFrame(left, "g string, at date, id int"), spark.createDataFrame(right, "g string, s date, e date, p int, k int")
    got = joins.interval_lookup(lefts, rights, ["g"], "at", "s", "e", F.col("p"), ["k"])
    assert got.columns == ["g", "at", "id", "k", "in_range"]
    key = lambda x: (x[0], x[1] is None, x[1], x[2])
    assert sorted(((x.id, x.k, x.in_range) for x in got.collect()), key=key) == sorted(want, key=key)
    assert joins.interval_lookup(lefts, rights.limit(0), ["g"], "at", "s", "e", F.col("p"), ["k"]).filter("k is null and not in_range").count() == len(left)


def test_labelled_topics(spark, tmp_path):
    import random

    r = random.Random(1)
    words = {"tax": "budget tax euro bank".split(), "war": "army war border peace".split(), None: "budget army tax war".split()}
    rows = [(i, label, " ".join(r.choice(words[label] + ["common", "speech"]) for _ in range(30))) for i, label in enumerate(["tax", "war", None] * 20)]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    p = topics.Params(topics_per_label=2, latent_topics=1, min_cf=3)
    m = topics.fit_labelled(df, "id", "text", "label", ["id"], p, iterations=15, step=5)
    assert m.beta.shape == (5, len(m.vocabulary)) and np.allclose(m.beta.sum(1), 1) and [i for i, _, _ in m.log] == [5, 10, 15]
    assert m.log[-1][1] >= m.log[0][1] - 1e-9 and m.topics[0] == (0, "tax 1") and m.topics[-1] == (4, "latent 1")
    found = {x.id: x.topics for x in topics.infer_labelled(df, "id", "text", m, label="label").collect()}
    for i, label, _ in rows:
        assert abs(sum(found[i]) - 1) < 1e-6
        if label == "tax":
            assert sum(found[i][2:4]) == 0
        if label == "war":
            assert sum(found[i][:2]) == 0
    free = {x.id: x.topics for x in topics.infer_labelled(df, "id", "text", m).collect()}
    assert np.mean([sum(free[i][:2]) > sum(free[i][2:4]) for i, label, _ in rows if label == "tax"]) > 0.9
    again = topics.fit_labelled(df, "id", "text", "label", ["id"], p, iterations=3)
    assert np.allclose(again.beta, topics.fit_labelled(df.repartition(3), "id", "text", "label", ["id"], p, iterations=3).beta)
    m.save(spark, str(tmp_path))
    back = topics.LabelledModel.load(spark, str(tmp_path))
    assert (back.labels, back.vocabulary, back.params) == (m.labels, m.vocabulary, m.params) and np.allclose(back.beta, m.beta)
    best, log = topics.grid_search(df, "id", "text", "label", ["id"], topics.grid(topics_per_label=[1, 2], latent_topics=[1], min_cf=[3]), iterations=2)
    assert sum(x["is_best"] for x in log) == 1 and min(x["perplexity"] for x in log) == best.log[-1][2]


def test_labelled_topics_of_odd_rows(spark):
    rows = [(1, "x", "tax bank tax"), (1, "x", "bank euro tax"), (2, "y", "army war army"), (3, "y", None), (None, "x", "tax tax"), (4, "y", "")]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    bags = {r.doc: r for r in topics._bags(df, "id", "text", "label", ["army", "bank", "tax"]).collect()}
    assert sorted(bags) == [1, 2] and bags[2].label == "y"
    t, c = topics._one(bags[1].terms, bags[1].counts)
    assert (t.tolist(), c.tolist()) == ([1, 2], [2.0, 3.0])
    assert topics._vocabulary(df, "text", 2, 1, 10) == ["army", "bank"]
    with pytest.raises(ValueError):
        topics._vocabulary(df, "text", 1, 0, 2)
    empty = topics.fit_labelled(df.limit(0), "id", "text", "label", ["id"], iterations=1)
    assert empty.beta.shape == (1, 0) and topics.infer_labelled(df, "id", "text", empty).count() == 0


def test_posteriors_of_a_block_are_those_of_plain_loops():
    r = np.random.default_rng(2)
    beta = r.dirichlet(np.ones(30), 5)
    docs = [(np.sort(r.permutation(30)[:n]), r.integers(1, 5, n).astype(float)) for n in (1, 7, 30, 12)]
    allowed = np.array([0, 3, 4])
    theta, terms, expected, ll = topics._posteriors(docs, allowed, beta, 0.1, 20)
    assert terms.tolist() == [x for t, _ in docs for x in t]
    at = 0
    for d, (t, c) in enumerate(docs):
        shares = [1 / 3] * 3
        for _ in range(20):
            n = [0.1] * 3
            for w, k in zip(t, c):
                mass = sum(shares[j] * beta[z, w] for j, z in enumerate(allowed))
                n = [n[j] + k * shares[j] * beta[z, w] / mass for j, z in enumerate(allowed)]
            new = [x / sum(n) for x in n]
            rests = max(abs(x - y) for x, y in zip(new, shares)) < 1e-6
            shares = new
            if rests:
                break
        np.testing.assert_allclose(theta[:, d], shares, rtol=1e-9)
        mass = [sum(shares[j] * beta[z, w] for j, z in enumerate(allowed)) for w in t]
        np.testing.assert_allclose(ll[d], sum(k * math.log(m) for k, m in zip(c, mass)))
        np.testing.assert_allclose(expected[:, at : at + len(t)], [[k * shares[j] * beta[z, w] / m for w, k, m in zip(t, c, mass)] for j, z in enumerate(allowed)])
        at += len(t)


def test_plain_topics(spark):
    rows = [(i, ("budget tax euro " if i % 2 else "army war border ") * 6) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    m = topics.PlainLDA(2, iterations=10).fit(df, "text")
    assert all(abs(sum(r.topics) - 1) < 1e-6 for r in m.transform(df, "text").collect()) and m.perplexity(df, "text") > 1
    profile = topics.held_out_perplexity(df, "id", "text", [2, 3], runs=2, iterations=3)
    assert topics.best_topic_count(profile) in (2, 3) and len(profile) == 4
    assert m.transform(spark.createDataFrame([(1, "unknown words only")], "id int, text string"), "text").count() == 0


def test_overrides_take_the_latest_window(spark):
    df = spark.createDataFrame([("c", day("2020-05-01"), "old"), ("c", day("2021-01-01"), "old"), ("d", day("2020-05-01"), "old")], "k string, at date, v string")
    rules = spark.createDataFrame([("c", day("2020-01-01"), day("2021-01-01"), "a"), ("c", day("2020-04-01"), None, "b")], "k string, start date, end date, v string")
    assert sorted((str(r["at"]), r.k, r.v) for r in panel.apply_overrides(df, rules, "k", "at", ["v"]).collect()) == [("2020-05-01", "c", "b"), ("2020-05-01", "d", "old"), ("2021-01-01", "c", "b")]


def test_coherence_and_diversity(spark):
    rows = [(i, ("budget tax euro " if i % 2 else "army war border ") * 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")
    profile = topics.coherence_profile(df, "text", [2], runs=1, top=3, iterations=8)
    assert profile[0]["runs"] == 1 and -1 <= profile[0]["npmi_mean"] <= 1 and profile[0]["npmi_std"] == 0.0
    assert topics.topic_diversity([["a", "b"], ["b", "c"]]) == 0.75
    a, b, _ = topics.shared_space(df, df.limit(4), "text", 2, iterations=2)
    assert a.count() == 40 and b.count() == 4
    assert aggs.sample_rows(df, 5).collect() == aggs.sample_rows(df.repartition(3), 5).collect()
