"""Queries over regressions, summaries and topic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggs, regression
from ..operators import topics as T
from .catalog import query, r6, t

X = ["l_quantity", "l_discount", "l_tax"]


@query("""SELECT round(sum(l_quantity * l_quantity) / 1e6, 6) AS xx, round(sum(l_quantity * l_discount) / 1e3, 6) AS xd, round(sum(l_discount * l_discount), 6) AS dd, round(sum(l_quantity * l_extendedprice) / 1e10, 6) AS xy, round(sum(l_discount * l_extendedprice) / 1e8, 6) AS dy, CAST(count(*) AS BIGINT) AS n FROM lineitem""")
def q_gram_matrix(spark, d):
    q, x, y = (F.col(c) for c in ("l_quantity", "l_discount", "l_extendedprice"))
    m, xy, _, _, n = regression.gram(t(spark, d, "lineitem"), [q, x], y)
    # Sums of a few numbers; one row.
    return spark.createDataFrame([(*(float(v) for v in (m[0, 0] / 1e6, m[0, 1] / 1e3, m[1, 1], xy[0] / 1e10, xy[1] / 1e8)), n)], "xx double, xd double, dd double, xy double, dy double, n long").select(*(r6(F.col(c)).alias(c) for c in ("xx", "xd", "dd", "xy", "dy")), "n")


@query("""WITH b AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) AS slope, count(*) AS n, var_pop(l_quantity) * count(*) AS sxx FROM lineitem),
e AS (SELECT l_quantity - mx AS dx, l_extendedprice - (my + slope * (l_quantity - mx)) AS e, mx, my, slope, n, sxx FROM lineitem, b),
s AS (SELECT min(mx) AS mx, min(my) AS my, min(slope) AS slope, min(n) AS n, min(sxx) AS sxx, sum(dx * dx * e * e) AS meat, sum(e * e) AS sse FROM e),
y AS (SELECT var_pop(l_extendedprice) * count(*) AS sst FROM lineitem)
SELECT round(slope, 4) AS slope, round(my - slope * mx, 3) AS intercept, round(sqrt(n / (n - 2) * meat) / sxx, 4) AS slope_se, round(1 - sse / sst, 6) AS r2, round(sqrt(sse / (n - 2)), 3) AS rmse, CAST(n AS BIGINT) AS n FROM s, y""")
def q_ols_simple_hc1(spark, d):
    f = regression.fit_ols(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    row = (float(f.beta[1]), float(f.beta[0]), f.table[1][2], f.r2, f.rmse, f.n)
    out = spark.createDataFrame([row], "slope double, intercept double, slope_se double, r2 double, rmse double, n long")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("slope_se", 4).alias("slope_se"), F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), "n")


@query("""WITH w AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS y FROM lineitem)
SELECT round(sum(x * y) / sum(x * x), 4) AS fe_slope, round(sum(x * y) / sum(x * x), 4) AS within_slope FROM w""")
def q_fe_demeaned_ols(spark, d):
    rows = t(spark, d, "lineitem")
    f = regression.fit_ols(rows, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    w = regression.within(rows.select("l_quantity", "l_extendedprice", "l_returnflag"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    slope = w.agg((F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum(F.col("l_quantity") * F.col("l_quantity"))).alias("s"))
    return slope.select(F.round(F.lit(float(f.beta[f.names.index("l_quantity")])), 4).alias("fe_slope"), F.round("s", 4).alias("within_slope"))


@query()
def q_ols_full(spark, d):
    """Coefficients with HC1 errors; tests hold them against a dense solution."""
    f = regression.fit_ols(t(spark, d, "lineitem"), "l_extendedprice", [*X, "l_linestatus"], ["l_returnflag"])
    return spark.createDataFrame(f.table, "term string, estimate double, std_error double, t_stat double, p_value double, ci_95_low double, ci_95_high double")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_returnflag = 'N' AS INT)::DOUBLE AS "FE_l_returnflag_N", CAST(l_returnflag = 'R' AS INT)::DOUBLE AS "FE_l_returnflag_R", CAST(l_linestatus = 'O' AS INT)::DOUBLE AS "l_linestatus_O" FROM lineitem""")
def q_design_matrix(spark, d):
    rows, columns = regression.design(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_linestatus"], ["l_returnflag"])
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return rows.select(*keys, *(c.alias(n) for n, c in columns if n != "const"))


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std, CAST(count(value) AS BIGINT) AS runs FROM events GROUP BY event_type""")
def q_metric_summary(spark, d):
    mean, spread, n = aggs.mean_spread(F.col("value"))
    return t(spark, d, "events").groupBy("event_type").agg(r6(mean).alias("mean"), r6(spread).alias("std"), n.alias("runs"))


@query("""WITH m AS (SELECT user_id % 20 AS k, avg(value) AS mean FROM events GROUP BY 1) SELECT CAST(k AS BIGINT) AS best FROM m ORDER BY round(mean, 9), k LIMIT 1""")
def q_argmin_topics(spark, d):
    m = t(spark, d, "events").groupBy((F.col("user_id") % 20).alias("k")).agg(F.round(F.avg("value"), 9).alias("mean"))
    return m.agg(F.min_by("k", F.struct("mean", "k")).alias("best"))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_tax) AS m, stddev_samp(l_tax) AS s FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round_even(m, 4) AS mean4, round(m - s, 6) AS low, round(m + s, 6) AS high FROM g""")
def q_rounding(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_tax").alias("m"), F.stddev_samp("l_tax").alias("s"))
    return g.select("l_returnflag", "l_linestatus", F.bround("m", 4).alias("mean4"), r6(F.col("m") - F.col("s")).alias("low"), r6(F.col("m") + F.col("s")).alias("high"))


@query("""SELECT label, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT doc_id, quality AS label FROM labels WHERE quality IS NOT NULL) GROUP BY label""")
def q_label_inference(spark, d):
    return t(spark, d, "labels").select("doc_id", F.col("quality").alias("label")).dropna().distinct().groupBy("label").agg(F.count("*").alias("n"))


@query()
def q_lda_topics(spark, d):
    """Plain topics of all documents with terms, over all of their terms."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    model = T.PlainLDA(6, seed=42, iterations=5, vocabulary=T.ALL_TERMS).fit(docs, "text")
    out = model.transform(docs, "text")
    return out.select("doc_id", F.transform("topics", lambda x: F.round(x, 4)).alias("topics"))


@query()
def q_plda_topics(spark, d):
    """Labelled topics: a block for each language and one latent topic; inference without labels."""
    docs = t(spark, d, "documents").select("doc_id", "text", "lang")
    params = T.Params(topics_per_label=2, latent_topics=1, min_cf=8, rm_top=5)
    model = T.fit_labelled(docs, "doc_id", "text", "lang", ["doc_id"], params, iterations=6, step=3)
    found = T.infer_labelled(docs.select("doc_id", "text"), "doc_id", "text", model, iterations=20)
    return found.select("doc_id", F.concat(F.lit("topic_"), V.argmax(F.col("topics")).cast("string")).alias("predicted_topic"), F.transform("topics", lambda x: F.round(x, 4)).alias("topics"))
