"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggs
from ..operators import cooccurrence as C
from ..sources import tei
from .catalog import query, r6, t


@query(r"""WITH x AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x85\x{a0}]+', ' ', 'g')) AS cleaned, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS toks FROM documents)
SELECT doc_id, md5(cleaned) AS cleaned_md5, CAST(len(toks) AS INT) AS n_tokens, CAST(len(list_filter(string_split(cleaned, ' '), lambda w: w <> '')) AS INT) AS n_words, CAST(len(list_distinct(toks)) AS INT) AS n_distinct FROM x WHERE len(toks) > 0""")
def q_clean_tokens(spark, d):
    x = F.col("text")
    rows = t(spark, d, "documents").select("doc_id", X.clean_text(x).alias("cleaned"), X.tokens(x).alias("toks"), X.word_count(x).alias("n_words"))
    return rows.filter(F.size("toks") > 0).select("doc_id", F.md5("cleaned").alias("cleaned_md5"), F.size("toks").alias("n_tokens"), "n_words", F.size(F.array_distinct("toks")).alias("n_distinct"))


COUNTS = r"""words AS (SELECT doc_id, lang, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 2)) AS term FROM documents), counts AS (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL)"""


@query(f"""WITH {COUNTS}, v AS (SELECT term, sum(n) AS cf FROM counts GROUP BY term HAVING sum(n) >= 5), top AS (SELECT term FROM v ORDER BY cf DESC, term LIMIT 20)
SELECT doc_id, term, CAST(n AS BIGINT) AS n FROM counts WHERE term IN (SELECT term FROM v) AND term NOT IN (SELECT term FROM top) AND term NOT IN ('the', 'und')""")
def q_term_counts(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return C.term_counts(docs, "doc_id", "text", min_cf=5, rm_top=20).filter(~F.col("term").isin("the", "und"))


@query(f"""WITH {COUNTS}, top AS (SELECT term FROM counts GROUP BY term ORDER BY sum(n) DESC, term LIMIT 20), dn AS (SELECT count(DISTINCT doc_id) AS n_docs FROM counts), p AS (SELECT doc_id, term FROM counts WHERE term IN (SELECT term FROM top)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), pr AS (SELECT x.term AS a, y.term AS b, count(*) AS pair FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL),
al AS (SELECT x.term AS a, y.term AS b FROM top x JOIN top y ON x.term < y.term)
SELECT a, b, CAST(coalesce(pair, 0) AS BIGINT) AS pair, CAST(f.df AS BIGINT) AS df_a, CAST(g.df AS BIGINT) AS df_b,
 round(CASE WHEN coalesce(pair, 0) = 0 THEN -1.0 WHEN pair >= n_docs THEN 1.0 ELSE ln((pair / n_docs) / ((f.df / n_docs) * (g.df / n_docs))) / -ln(pair / n_docs) END, 6) AS npmi
FROM al LEFT JOIN pr USING (a, b) JOIN df f ON a = f.term JOIN df g ON b = g.term, dn""")
def q_pair_npmi(spark, d):
    docs = t(spark, d, "documents")
    return C.pair_npmi(docs, "text", C.corpus_top_terms(docs, "text", 20)).select("a", "b", "pair", "df_a", "df_b", r6(F.col("value")).alias("npmi"))


@query(f"""WITH {COUNTS}, top AS (SELECT term FROM counts GROUP BY term ORDER BY sum(n) DESC, term LIMIT 10), dn AS (SELECT count(DISTINCT doc_id) AS n_docs FROM counts), p AS (SELECT doc_id, term FROM counts WHERE term IN (SELECT term FROM top)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term), pr AS (SELECT x.term AS a, y.term AS b, count(*) AS pair FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.term <> y.term GROUP BY ALL),
ctx AS (SELECT x.term AS w, y.term AS c, CASE WHEN x.term = y.term THEN 1.0 WHEN pair IS NULL THEN 0.0 WHEN pair >= n_docs THEN 1.0 ELSE greatest(0.0, ln((pair / n_docs) / ((f.df / n_docs) * (g.df / n_docs))) / -ln(pair / n_docs)) END AS v
 FROM top x CROSS JOIN top y LEFT JOIN pr ON pr.a = x.term AND pr.b = y.term JOIN df f ON f.term = x.term JOIN df g ON g.term = y.term, dn),
nm AS (SELECT w, sqrt(sum(v * v)) AS nrm FROM ctx GROUP BY w), cs AS (SELECT x.w AS w1, y.w AS w2, sum(x.v * y.v) AS dt FROM ctx x JOIN ctx y ON x.c = y.c AND x.w < y.w GROUP BY ALL)
SELECT round(avg(dt / (a.nrm * b.nrm)), 6) AS coherence, CAST(count(*) AS BIGINT) AS n_pairs FROM cs JOIN nm a ON a.w = w1 JOIN nm b ON b.w = w2""")
def q_cv_context(spark, d):
    docs = t(spark, d, "documents")
    row = C.context_coherence(C.pair_npmi(docs, "text", C.corpus_top_terms(docs, "text", 10)))
    return spark.createDataFrame([row], "coherence double, n_pairs long").select(r6(F.col("coherence")).alias("coherence"), "n_pairs")


@query(f"""WITH {COUNTS}, c AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL), r AS (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c)
SELECT lang, term, CAST(n AS BIGINT) AS weight, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def q_top_words(spark, d):
    docs = t(spark, d, "documents")
    counts = C.term_counts(docs.select("doc_id", "text"), "doc_id", "text").join(docs.select("doc_id", "lang"), "doc_id")
    return C.top_terms(counts, ["lang"], 10).select("lang", "term", "weight", "rank")


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c)
SELECT source, round(max(p), 6) AS purity, round(CASE WHEN count(*) > 1 THEN sum(-p * ln(p)) / ln(count(*)) ELSE 0.0 END, 6) AS fragmentation FROM p GROUP BY source""")
def q_purity_entropy(spark, d):
    c = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return C.purity_entropy(c, "source", "lang", "n").select("source", r6(F.col("purity")).alias("purity"), r6(F.col("fragmentation")).alias("fragmentation"))


@query("""SELECT conv_id, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id""")
def q_ordered_concat(spark, d):
    c = t(spark, d, "conversations")
    joined = aggs.ordered_concat(c, ["conv_id"], "text", ["turn"])
    return joined.join(c.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id").select("conv_id", F.md5("text").alias("text_md5"), "n")


@query("""SELECT conv_id, arg_min(role, turn) FILTER (role IS NOT NULL AND role <> 'user') AS first_other, arg_min(length(text), turn) FILTER (length(text) > 100) AS first_long FROM conversations GROUP BY conv_id""")
def q_first_nonnull(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") != "user", F.col("role")).alias("first_other"), F.when(F.length("text") > 100, F.length("text").cast("long")).alias("first_long"))
    return aggs.first_non_null(c, ["conv_id"], ["first_other", "first_long"], ["turn"])


@query("""WITH f AS (SELECT source, min(doc_id) AS seen FROM documents WHERE source IS NOT NULL GROUP BY source), p AS (SELECT source, row_number() OVER (ORDER BY seen) - 1 AS position FROM f)
SELECT source, CAST(position AS INT) AS position, CAST(position * 3 + i AS INT) AS topic, source || ' ' || (i + 1) AS display FROM p, (SELECT unnest([0, 1, 2]) AS i)""")
def q_first_seen_labels(spark, d):
    p = aggs.first_seen(t(spark, d, "documents"), "source", ["doc_id"])
    e = p.select("source", "position", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return e.select("source", "position", (F.col("position") * 3 + F.col("i")).alias("topic"), X.display_label(F.col("source"), F.col("i") + 1).alias("display"))


@query("""WITH c AS (SELECT conv_id, turn, role, (role = 'user') AS u, (length(text) > 200) AS l, (text LIKE '%?%') AS q FROM conversations),
m AS (SELECT conv_id, avg(CASE WHEN u THEN 1.0 ELSE 0.0 END) AS v0, avg(CASE WHEN l THEN 1.0 ELSE 0.0 END) AS v1, avg(CASE WHEN q THEN 1.0 ELSE 0.0 END) AS v2, count(*) AS n FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS quasi_sentence_count, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v2, 6) AS v2, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 'topic_0' WHEN v1 >= v2 THEN 'topic_1' ELSE 'topic_2' END AS predicted_topic FROM m""")
def q_doc_topics_from_sentences(spark, d):
    from ..functions import vectors as V

    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    c = t(spark, d, "conversations").select("conv_id", F.array(one(F.col("role") == "user"), one(F.length("text") > 200), one(F.coalesce(F.col("text").contains("?"), F.lit(False)))).alias("v"))
    docs = aggs.as_vectors(aggs.mean_vector(c, ["conv_id"], "v"), ["conv_id"]).join(c.groupBy("conv_id").agg(F.count("*").alias("quasi_sentence_count")), "conv_id")
    topic = F.concat(F.lit("topic_"), V.argmax(F.col("vector")).cast("string"))
    return docs.select("conv_id", "quasi_sentence_count", *(r6(F.col("vector")[i]).alias(f"v{i}") for i in range(3)), topic.alias("predicted_topic"))


@query("""WITH x AS (SELECT conv_id, turn, '#' || role || CASE WHEN turn % 2 = 0 THEN ' topic:t' || turn || ' extra' ELSE ' extra x' || turn END AS ana, role, turn AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN role IN ('user', 'chair', 'regular', 'guest') THEN role ELSE '' END AS speaker_type, CASE WHEN k % 2 = 0 THEN 't' || k ELSE '' END AS topic_code,
 CASE WHEN role IN ('user', 'chair', 'regular', 'guest') THEN '' ELSE '#' || role || ' | ' END || 'extra' || CASE WHEN k % 2 = 0 THEN '' ELSE ' | x' || k END AS ana_extra,
 CASE WHEN k % 4 = 0 THEN 'speaker_marker' WHEN k % 4 = 1 THEN 'procedural_commentary' ELSE 'note' END AS note_kind FROM x""")
def q_speaker_markers(spark, d):
    k = F.col("turn")
    even = k % 2 == 0
    ana = F.concat(F.lit("#"), "role", F.when(even, F.concat(F.lit(" topic:t"), k.cast("string"), F.lit(" extra"))).otherwise(F.concat(F.lit(" extra x"), k.cast("string"))))
    note = F.when(k % 4 == 0, "speaker").when(k % 4 == 1, "time").otherwise("applause")
    rows = t(spark, d, "conversations").withColumn("ana", ana)
    marks = tei.parse_markers(F.col("ana"), F.lit([*tei.ROLES, "user"]))
    return rows.select("conv_id", "turn", *(c.alias(n) for n, c in marks.items()), tei.note_kind(F.lit("debate"), note).alias("note_kind"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type || ':' || CAST(json_extract(props, '$.k') AS VARCHAR) AS item FROM events""")
def q_json_items(spark, d):
    j = F.from_json("props", "k long")
    return t(spark, d, "events").select("event_id", j["k"].alias("k"), F.concat_ws(":", "event_type", j["k"].cast("string")).alias("item"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'n/a' WHEN 2 THEN ' 12 ' ELSE NULL END AS raw, event_type, CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'Yes' WHEN event_type = 'view' THEN '0' WHEN event_type = 'click' THEN 'maybe' ELSE 'TRUE' END AS flag FROM events)
SELECT event_type, round(sum(TRY_CAST(trim(raw) AS DOUBLE)), 4) AS total, CAST(count(TRY_CAST(trim(raw) AS DOUBLE)) AS BIGINT) AS n_numeric, bool_and(lower(trim(flag)) IN ('true', 'false', '1', '0', 'yes', 'no')) AS is_bool, CAST(count(*) FILTER (lower(trim(flag)) IN ('true', '1', 'yes')) AS BIGINT) AS n_true FROM s GROUP BY event_type""")
def q_coerce_types(spark, d):
    k, e = F.col("event_id") % 4, F.col("event_type")
    raw = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "n/a").when(k == 2, " 12 ")
    flag = F.when((e == "view") & (F.col("event_id") % 2 == 0), "Yes").when(e == "view", "0").when(e == "click", "maybe").otherwise("TRUE")
    s = t(spark, d, "events").select("event_type", F.trim(raw).try_cast("double").alias("x"), flag.alias("flag"))
    return s.groupBy("event_type").agg(F.round(F.sum("x"), 4).alias("total"), F.count("x").alias("n_numeric")).join(aggs.all_truthy(s, "flag", ["event_type"]), "event_type")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INT) AS n_links, regexp_extract(url, '://([^/]+)', 1) AS host, CAST(length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), ' +', ' ', 'g'))) AS INT) AS n_text FROM pages""")
def q_page_extract(spark, d):
    h = F.col("html")
    plain = F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]*>", " "), " +", " "))
    return t(spark, d, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("n_links"), F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.length(plain).alias("n_text")
    )


@query("""SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS plda_doc_id, source FROM documents WHERE trim(text) <> ''""")
def q_row_numbers(spark, d):
    rows = t(spark, d, "documents").filter(F.trim("text") != "")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("plda_doc_id"), "source")


@query("""SELECT r_regionkey, array_to_string(list_distinct_ordered, ',') AS codes FROM (SELECT r_regionkey, [replace(upper(r_name), ' ', ','), 'CZ', 'LV'] AS list_distinct_ordered FROM region)""")
def q_ordered_unique(spark, d):
    return t(spark, d, "region").select("r_regionkey", F.array_join(X.ordered_unique_codes(F.concat(F.lower("r_name"), F.lit(", cz lv,,CZ "))), ",").alias("codes"))
