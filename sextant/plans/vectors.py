"""Queries over topic vectors; embeddings stand in for topic shares after clipping and normalizing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import aggs
from ..operators.joins import sized_broadcast
from .catalog import query, r6, t

SHARES = """long AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings), pos AS (SELECT vec_id, label, dim, greatest(CAST(x AS DOUBLE), 0.0) AS x FROM long),
p AS (SELECT vec_id, label, dim, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM pos)"""


def shares(spark, d):
    e = t(spark, d, "embeddings")
    return e.select("vec_id", "label", V.clipped_normalized(F.col("embedding")).alias("p"))


@query(f"""WITH {SHARES} SELECT vec_id, CAST(dim AS INT) AS dim, round(p, 6) AS value FROM p""")
def q_normalize_vector(spark, d):
    return shares(spark, d).select("vec_id", F.posexplode("p").alias("dim", "v")).select("vec_id", "dim", r6(F.col("v")).alias("value"))


@query(f"""WITH {SHARES} SELECT label, CAST(dim AS INT) AS dim, round(avg(p), 6) AS value FROM p GROUP BY ALL""")
def q_mean_vector(spark, d):
    return aggs.mean_vector(shares(spark, d), ["label"], "p").select("label", "dim", r6(F.col("value")).alias("value"))


@query(f"""WITH {SHARES} SELECT label, CAST(dim AS INT) AS dim, round(sum(p * ln(1 + n_chars)) / sum(ln(1 + n_chars)), 6) AS value FROM p JOIN documents ON doc_id = vec_id GROUP BY ALL""")
def q_weighted_mean_vector(spark, d):
    rows = shares(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    return aggs.mean_vector(rows, ["label"], "p", F.log1p("n_chars")).select("label", "dim", r6(F.col("value")).alias("value"))


CENTROIDS = SHARES + """, c AS (SELECT label, dim, avg(p) AS q FROM p GROUP BY ALL), j AS (SELECT vec_id, p.label, dim, p, q FROM p JOIN c USING (label, dim)),
s AS (SELECT vec_id, label, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0) / 2 / ln(2)) AS js, sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))) AS cosine, sqrt(sum(power(sqrt(p) - sqrt(q), 2))) / sqrt(2) AS hellinger FROM j GROUP BY vec_id, label)"""


def alignment(spark, d):
    """Each vector against the mean of its label."""
    rows = shares(spark, d)
    centres = aggs.as_vectors(aggs.mean_vector(rows, ["label"], "p"), ["label"], "q")
    j = rows.join(sized_broadcast(centres), "label")
    p, q = F.col("p"), F.col("q")
    return j.select("vec_id", "label", V.js_distance(p, q).alias("js"), V.cosine(p, q).alias("cosine"), V.hellinger(p, q).alias("hellinger"))


@query(f"""WITH {CENTROIDS} SELECT vec_id, label, round(js, 6) AS js_distance, round(1 - js, 6) AS alignment_score, round(cosine, 6) AS cosine_similarity, round(hellinger, 6) AS hellinger_distance FROM s""")
def q_js_cos_hell(spark, d):
    a = alignment(spark, d)
    return a.select("vec_id", "label", r6(F.col("js")).alias("js_distance"), r6(1 - F.col("js")).alias("alignment_score"), r6(F.col("cosine")).alias("cosine_similarity"), r6(F.col("hellinger")).alias("hellinger_distance"))


@query("""SELECT vec_id, 'topic_' || (list_position(embedding, list_max(embedding)) - 1) AS predicted_topic FROM embeddings""")
def q_argmax_topic(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("topic_"), V.argmax(F.col("embedding")).cast("string")).alias("predicted_topic"))


@query(f"""WITH {CENTROIDS} SELECT source AS party, round(sum(js * n_chars) / sum(n_chars), 6) AS jsd_weighted, round(avg(js), 6) AS jsd_mean, CAST(count(DISTINCT label) AS BIGINT) AS active_manifestos, string_agg(DISTINCT CAST(label AS VARCHAR), '|' ORDER BY CAST(label AS VARCHAR)) AS active_doc_keys,
 min(vec_id) AS first_id, max(vec_id) AS last_id FROM s JOIN documents ON doc_id = vec_id GROUP BY source""")
def q_weighted_jsd_month(spark, d):
    j = alignment(spark, d).join(t(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("party"), "n_chars"), "vec_id")
    return j.groupBy("party").agg(
        r6(aggs.weighted_mean(F.col("js"), F.col("n_chars"))).alias("jsd_weighted"),
        r6(F.avg("js")).alias("jsd_mean"),
        F.countDistinct("label").alias("active_manifestos"),
        F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), "|").alias("active_doc_keys"),
        F.min("vec_id").alias("first_id"),
        F.max("vec_id").alias("last_id"),
    )


@query(f"""WITH {CENTROIDS}, m AS (SELECT label, avg(js) AS js_distance, avg(1 - js) AS alignment_score, avg(hellinger) AS hellinger_distance FROM s GROUP BY label),
u AS (SELECT label, unnest(['alignment_score', 'hellinger_distance', 'js_distance']) AS metric, unnest([alignment_score, hellinger_distance, js_distance]) AS value FROM m)
SELECT label, metric, round(value, 6) AS value, round(sum(value) OVER (PARTITION BY label ORDER BY metric), 6) AS bottom FROM u""")
def q_unpivot_metrics(spark, d):
    m = alignment(spark, d).groupBy("label").agg(F.avg("js").alias("js_distance"), F.avg(1 - F.col("js")).alias("alignment_score"), F.avg("hellinger").alias("hellinger_distance"))
    u = m.unpivot("label", ["alignment_score", "hellinger_distance", "js_distance"], "metric", "value")
    running = F.sum("value").over(Window.partitionBy("label").orderBy("metric").rowsBetween(Window.unboundedPreceding, 0))
    return u.select("label", "metric", r6(F.col("value")).alias("value"), r6(running).alias("bottom"))


@query(f"""WITH {SHARES}, v AS (SELECT vec_id, dim, p / sum(p) OVER (PARTITION BY vec_id) AS value FROM p WHERE dim < 60) SELECT vec_id, CAST(dim AS INT) AS dim, round(value, 6) AS value FROM v""")
def q_visible_topics(spark, d):
    """Shares without the last four topics, normalized anew."""
    visible = shares(spark, d).withColumn("v", V.normalized(F.slice("p", 1, F.size("p") - 4)))
    return visible.select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", "dim", r6(F.col("x")).alias("value"))
