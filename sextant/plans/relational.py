"""Queries over grouping, joining, sets and lookups. Orders stand in for speeches, market segments for parties."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dates import month, month_start
from ..operators import aggs, joins, panel
from ..sources.files import union_tables
from .catalog import query, r6, t


def speeches(spark, d):
    """Orders with their customer's segment as party and their date."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "c_nationkey", F.col("c_mktsegment").alias("party"), F.col("o_orderdate").cast("date").alias("date"))
    return rows.withColumns({"month": month(F.col("date")), "month_start": month_start(F.col("date"))})


SPEECHES = """speeches AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, c_nationkey, c_mktsegment AS party, CAST(o_orderdate AS DATE) AS date,
 strftime(o_orderdate, '%Y-%m') AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {SPEECHES}, m AS (SELECT party, month, month_start, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM speeches GROUP BY ALL)
SELECT party, month, month_start, n AS speech_volume_segments, CAST(cents AS BIGINT) AS cents, round(ln(1 + n), 6) AS log1p_segments, round(n / sum(n) OVER (PARTITION BY month), 6) AS speech_segment_share,
 CAST(sum(n) OVER (PARTITION BY month) AS BIGINT) AS month_total FROM m""")
def q_party_month_volume(spark, d):
    m = speeches(spark, d).groupBy("party", "month", "month_start").agg(F.count("*").alias("speech_volume_segments"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    m = aggs.with_share(m, "speech_volume_segments", ["month"], "share")
    total = F.sum("speech_volume_segments").over(Window.partitionBy("month"))
    return m.select("party", "month", "month_start", "speech_volume_segments", "cents", r6(F.log1p("speech_volume_segments")).alias("log1p_segments"), r6(F.col("share")).alias("speech_segment_share"), total.alias("month_total"))


@query("""WITH s AS (SELECT n_name, count(*) AS speech_rows, min(CAST(o_orderdate AS DATE)) AS speech_start_date, max(CAST(o_orderdate AS DATE)) AS speech_end_date
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT s.*, n_nationkey AS party_id FROM s JOIN nation USING (n_name) WHERE n_regionkey IN (1, 2) ORDER BY n_name""")
def q_eligible_index(spark, d):
    n = t(spark, d, "nation")
    s = speeches(spark, d).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
    s = s.agg(F.count("*").alias("speech_rows"), F.min("date").alias("speech_start_date"), F.max("date").alias("speech_end_date"))
    mapped = n.filter(F.col("n_regionkey").isin(1, 2)).select("n_name", F.col("n_nationkey").alias("party_id"))
    return s.join(joins.sized_broadcast(mapped), "n_name").orderBy("n_name")


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus FROM orders),
s AS (SELECT l_orderkey, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_orderstatus, coalesce(lines, 0) AS lines, round(coalesce(quantity, 0), 6) AS quantity, round(ln(1 + CASE WHEN coalesce(quantity, 0) <= 0 THEN 1 ELSE quantity END), 6) AS log_quantity,
 coalesce(quantity > 100, false) AS over_half FROM l LEFT JOIN s ON o_orderkey = l_orderkey""")
def q_left_covariates(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(s, "o_orderkey", "left")
    q = F.coalesce("quantity", F.lit(0.0))
    return rows.select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.lit(0)).alias("lines"), r6(q).alias("quantity"), r6(F.log1p(F.when(q <= 0, 1.0).otherwise(q))).alias("log_quantity"), panel.majority(F.col("quantity"), F.lit(200)).alias("over_half"))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows_joined, CAST(count(c_custkey) AS BIGINT) AS matched, CAST(count(o_orderkey) AS BIGINT) AS with_orders
FROM orders RIGHT JOIN customer ON o_custkey = c_custkey""")
def q_right_join_counts(spark, d):
    o, c = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").select("c_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "right").agg(F.count("*").alias("rows_joined"), F.count("c_custkey").alias("matched"), F.count("o_orderkey").alias("with_orders"))


@query(f"""WITH {SPEECHES} SELECT party, date, month, month_start, count(*) AS speech_rows, party || '_' || strftime(date, '%Y%m%d') AS doc_key
FROM speeches WHERE o_orderstatus IN ('F', 'O') AND trim(party) <> '' GROUP BY ALL""")
def q_speech_dates(spark, d):
    s = speeches(spark, d).filter(F.col("o_orderstatus").isin("F", "O") & (F.trim("party") != "")).dropna(subset=["date"])
    return s.groupBy("party", "date", "month", "month_start").agg(F.count("*").alias("speech_rows")).withColumn("doc_key", F.concat_ws("_", "party", F.date_format("date", "yyyyMMdd")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1""")
def q_dedupe_first(spark, d):
    order = [F.desc("l_quantity"), F.col("l_shipdate").desc_nulls_last(), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber"), F.asc("l_extendedprice")]
    return aggs.keep_first(t(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("l_shipdate"))


@query("""SELECT l_orderkey, l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def q_repeated_keys(spark, d):
    return aggs.repeated(t(spark, d, "lineitem").select("l_orderkey", "l_partkey"), ["l_orderkey", "l_partkey"]).groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_suppkey AS k, sum(CAST(l_quantity AS BIGINT)) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS s FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS party, CAST(coalesce(a.s, b.s) AS BIGINT) AS party_seats, CASE WHEN a.s IS NOT NULL THEN 'parliament_composition' ELSE 'election_result' END AS party_seat_source FROM a FULL JOIN b ON a.k = b.k""")
def q_seat_panel_outer(spark, d):
    a = t(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("party"), F.col("l_quantity").cast("long").alias("seats"))
    b = t(spark, d, "orders").select(F.col("o_custkey").alias("party"), F.lit(1).cast("long").alias("seats"))
    return panel.seats(a, b, ["party"], "seats")


@query("""WITH m AS (SELECT o_custkey AS cabinet, CAST(count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F') AS BIGINT) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderstatus = 'F') AS s FROM orders GROUP BY 1)
SELECT c_custkey AS cabinet, coalesce(n, 0) AS cabinet_party_count, CAST(coalesce(s, 0) AS BIGINT) AS cabinet_gov_seats, coalesce(n, 0) > 1 AS cabinet_is_coalition FROM customer LEFT JOIN m ON cabinet = c_custkey""")
def q_cabinet_summary(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("cabinet"), "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("seats"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("cabinet"))
    return panel.cabinet_summary(o, c, "cabinet", "o_orderpriority", F.col("o_orderstatus") == "F", "seats")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'prime_minister_party' WHEN o_orderstatus = 'F' THEN 'coalition_partner'
 WHEN o_orderpriority = '1-URGENT' AND o_totalprice < 50000 THEN 'nonpartisan_caretaker' ELSE 'opposition' END AS party_government_status FROM orders""")
def q_status_case(spark, d):
    flag = lambda c: F.when(c, 1).otherwise(0)
    done, price = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    status = panel.government_status(flag(done & (price > 100000)), flag(done), flag(F.col("o_orderpriority") == "1-URGENT"), flag(price >= 50000))
    return t(spark, d, "orders").select("o_orderkey", status.alias("party_government_status"))


@query("""WITH f AS (SELECT l_orderkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey, l_partkey, l_quantity, l_linenumber FROM orders JOIN f ON o_orderkey = f.l_orderkey JOIN lineitem l ON l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.first_line""")
def q_first_composition(spark, d):
    t(spark, d, "lineitem").createOrReplaceTempView("v_lineitem")
    t(spark, d, "orders").createOrReplaceTempView("v_orders")
    return spark.sql(
        """WITH first_lines AS (SELECT l_orderkey AS k, min(l_linenumber) AS line FROM v_lineitem GROUP BY l_orderkey)
        SELECT o_orderkey, o_custkey, l_partkey, l_quantity, l_linenumber FROM v_orders JOIN first_lines ON o_orderkey = k JOIN v_lineitem ON l_orderkey = k AND l_linenumber = line"""
    )


@query("""SELECT DISTINCT n_name, c_mktsegment FROM nation JOIN customer ON n_nationkey = c_nationkey""")
def q_sql_distinct(spark, d):
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    return n.join(c, n.n_nationkey == c.c_nationkey).select("n_name", "c_mktsegment").distinct()


@query("""SELECT DISTINCT r_name, n_name, s_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey
WHERE r_name = 'EUROPE' AND s_acctbal > 1000 ORDER BY n_name, s_name""")
def q_sql_views(spark, d):
    views = {name: t(spark, d, name) for name in ("region", "nation", "supplier", "customer")}
    return spark.sql(
        """SELECT DISTINCT r_name, n_name, s_name FROM {region} JOIN {nation} ON r_regionkey = n_regionkey JOIN {supplier} ON s_nationkey = n_nationkey JOIN {customer} ON c_nationkey = n_nationkey
        WHERE r_name = :region_name AND s_acctbal > :least ORDER BY n_name, s_name""",
        args={"region_name": "EUROPE", "least": 1000},
        **views,
    )


@query("""SELECT o_orderkey AS key, o_custkey, o_orderstatus AS name_speech, c_name AS name_party FROM orders JOIN customer ON o_custkey = c_custkey""")
def q_validated_join(spark, d):
    left = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", F.col("o_orderstatus").alias("name"))
    right = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    return joins.validated_join(left, right, ["o_custkey"], validate="many_to_one", suffixes=("_speech", "_party"))


@query("""WITH a AS (SELECT d.doc_id, l.toxic, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)),
b AS (SELECT toxic, lang, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL)
SELECT a.doc_id, a.toxic, a.lang, b.n FROM a JOIN b ON a.toxic IS NOT DISTINCT FROM b.toxic AND a.lang IS NOT DISTINCT FROM b.lang""")
def q_null_safe_join(spark, d):
    a = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    b = a.groupBy("toxic", "lang").agg(F.count("*").alias("n"))
    return joins.null_safe_join(a, b, ["toxic", "lang"]).select("doc_id", "toxic", "lang", "n")


@query("""WITH top AS (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 3) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM top)""")
def q_semi_top_parties(spark, d):
    return aggs.top_groups(t(spark, d, "documents").select("doc_id", "source"), "source", 3).select("doc_id", "source")


@query("""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_anti_unmapped(spark, d):
    return joins.unmatched(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), ["doc_id"])


@query("""WITH a AS (SELECT DISTINCT upper(trim(p_brand)) AS label FROM part WHERE p_size < 25), b AS (SELECT DISTINCT upper(trim(p_brand)) AS label FROM part WHERE p_size >= 40), c AS (SELECT DISTINCT upper(r_name) AS label FROM region)
SELECT 'match_any' AS kind, label FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_left', label FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'either', label FROM (SELECT * FROM b UNION SELECT * FROM c)""")
def q_label_sets(spark, d):
    p = t(spark, d, "part").select(X.normalized(F.col("p_brand")).alias("label"), "p_size")
    a, b = p.filter("p_size < 25").select("label"), p.filter("p_size >= 40").select("label")
    c = t(spark, d, "region").select(X.normalized(F.col("r_name")).alias("label"))
    kinds = (("match_any", a.intersect(b)), ("only_left", a.subtract(b)), ("either", b.union(c).distinct()))
    out = None
    for name, df in kinds:
        one = df.select(F.lit(name).alias("kind"), "label")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'customer' AS country_code, c_custkey AS id, c_acctbal AS acctbal, c_mktsegment AS segment, c_nationkey AS nation FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL, s_nationkey FROM supplier""")
def q_union_pooled(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return union_tables({"customer": c, "supplier": s}).select("country_code", "id", "acctbal", "segment", "nation")


@query("""WITH speech AS (SELECT DISTINCT p_name AS label, upper(trim(p_name)) AS norm, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS canon FROM part),
cat AS (SELECT DISTINCT upper(p_brand || ' ' || p_type) AS name, p_name, p_partkey % 50 AS entity FROM part),
manual AS (SELECT 'SMALL RING' AS key, 7 AS entity, 'manual ring' AS name),
x AS (SELECT upper(trim(p_name)) AS key, p_partkey % 50 AS entity, min(p_brand) AS name FROM part WHERE p_size <= 10 GROUP BY ALL),
ex AS (SELECT key, count(DISTINCT entity) AS n, min(entity) AS e, min(struct_pack(name := name, entity := entity)) AS p, string_agg(DISTINCT CAST(entity AS VARCHAR) || ':' || name, '; ' ORDER BY CAST(entity AS VARCHAR) || ':' || name) AS everything FROM x GROUP BY key),
y AS (SELECT upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS key, p_partkey % 2 + 100 AS entity, min(p_type) AS name FROM part WHERE p_size > 49 GROUP BY ALL),
ey AS (SELECT key, count(DISTINCT entity) AS n, min(struct_pack(name := name, entity := entity)) AS p FROM y GROUP BY key)
SELECT s.label, coalesce(m.entity, CASE WHEN ex.n = 1 THEN ex.p.entity END, CASE WHEN ey.n = 1 THEN ey.p.entity END) AS entity,
 CASE WHEN m.key IS NOT NULL THEN 'manual' WHEN ex.n = 1 THEN 'exact' WHEN ey.n = 1 THEN 'canonical' ELSE 'unmapped' END AS method,
 coalesce(m.name, CASE WHEN ex.n = 1 THEN ex.p.name END, CASE WHEN ey.n = 1 THEN ey.p.name END) AS entity_name,
 CASE WHEN ex.n > 1 THEN 'Ambiguous ' || ex.key || ' -> ' || ex.everything END AS exact_note
FROM speech s LEFT JOIN manual m ON s.norm = m.key LEFT JOIN ex ON s.norm = ex.key LEFT JOIN ey ON s.canon = ey.key""")
def q_cascade_mapping(spark, d):
    p = t(spark, d, "part")
    labels = p.select(F.col("p_name").alias("label")).distinct()
    manual = spark.createDataFrame([("SMALL RING", 7, "manual ring")], "k string, entity long, name string")
    key = F.col("label")
    steps = [
        ("manual", X.normalized(key), joins.lookup_table(manual, F.col("k"), "entity", "name")),
        ("exact", X.normalized(key), joins.lookup_table(p.filter("p_size <= 10").groupBy(X.normalized(F.col("p_name")).alias("k"), (F.col("p_partkey") % 50).alias("entity")).agg(F.min("p_brand").alias("name")), F.col("k"), "entity", "name")),
        ("canonical", X.canonical_ascii(key), joins.lookup_table(p.filter("p_size > 49").groupBy(X.canonical_ascii(F.col("p_name")).alias("k"), (F.col("p_partkey") % 2 + 100).alias("entity")).agg(F.min("p_type").alias("name")), F.col("k"), "entity", "name")),
    ]
    found = joins.cascade_lookup(labels, "label", steps)
    # Only notes of the exact step are compared.
    note = steps[1][2].select(F.col("key").alias("nk"), F.col("note").alias("exact_note"))
    return found.withColumn("nk", X.normalized(key)).join(joins.sized_broadcast(note), "nk", "left").select("label", "entity", "method", "entity_name", "exact_note")


@query("""SELECT p_partkey, CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'dictionary' WHEN starts_with(p_name, 's') THEN 'group' WHEN p_brand LIKE '%5' THEN 'suffix' ELSE 'party' END AS label_type,
 CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'Known label ' || p_type ELSE 'No rule for ' || p_name END AS note FROM part""")
def q_label_type(spark, d):
    known = F.col("p_type").isin("PROMO", "STANDARD")
    kind = F.when(known, "dictionary").when(F.col("p_name").startswith("s"), "group").when(F.col("p_brand").endswith("5"), "suffix").otherwise("party")
    note = F.when(known, F.format_string("Known label %s", "p_type")).otherwise(F.format_string("No rule for %s", "p_name"))
    return t(spark, d, "part").select("p_partkey", kind.alias("label_type"), note.alias("note"))


BROAD = {"error": "Failure", "click": "Interaction", "view": "Interaction", "purchase": "Economy", "signup": "Economy"}


@query("""SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'Interaction' WHEN 'view' THEN 'Interaction' WHEN 'purchase' THEN 'Economy' WHEN 'signup' THEN 'Economy' WHEN 'error' THEN 'Failure' END AS broad_topic FROM events""")
def q_broad_topic(spark, d):
    table = F.create_map(*(F.lit(x) for pair in BROAD.items() for x in pair))
    return t(spark, d, "events").select("event_id", "event_type", F.try_element_at(table, F.col("event_type")).alias("broad_topic"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS share FROM c)
SELECT source, round(coalesce(sum(share) FILTER (lang = 'de'), 0), 6) AS de, round(coalesce(sum(share) FILTER (lang = 'en'), 0), 6) AS en, round(coalesce(sum(share) FILTER (lang = 'es'), 0), 6) AS es, round(coalesce(sum(share) FILTER (lang = 'fr'), 0), 6) AS fr FROM s GROUP BY source""")
def q_annotated_distribution(spark, d):
    c = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    wide = aggs.pivot_share(aggs.with_share(c, "n", ["source"], "share"), ["source"], "lang", ["de", "en", "es", "fr"], "share")
    return wide.select("source", *(r6(F.col(x)).alias(x) for x in ("de", "en", "es", "fr")))


@query("""SELECT source AS label, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL AND trim(source) <> '' GROUP BY source ORDER BY label""")
def q_label_counts(spark, d):
    s = t(spark, d, "documents").select(F.trim("source").alias("label")).dropna().filter("label <> ''")
    return s.groupBy("label").agg(F.count("*").alias("n")).orderBy("label")


@query("""SELECT n_name AS partyname, CAST(count(*) AS BIGINT) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, partyname LIMIT 10""")
def q_value_counts(spark, d):
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    return c.join(joins.sized_broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("partyname")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "partyname").limit(10)


@query("""SELECT DISTINCT n_name AS partyname, replace(p_name, ',', '') AS cleaned FROM nation JOIN region ON n_regionkey = r_regionkey JOIN part ON p_partkey = n_nationkey WHERE r_name IN ('ASIA', 'EUROPE') ORDER BY partyname, cleaned""")
def q_catalogue_lookup(spark, d):
    n, r, p = t(spark, d, "nation"), t(spark, d, "region"), t(spark, d, "part")
    kept = n.join(r, n.n_regionkey == r.r_regionkey).filter(F.col("r_name").isin("ASIA", "EUROPE"))
    return kept.join(p, p.p_partkey == n.n_nationkey).select(F.col("n_name").alias("partyname"), F.regexp_replace("p_name", ",", "").alias("cleaned")).distinct().orderBy("partyname", "cleaned")


@query("""SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders ORDER BY o_orderdate, o_custkey DESC, o_orderkey LIMIT 40""")
def q_file_limit(spark, d):
    return t(spark, d, "orders").orderBy(F.col("o_orderdate").asc_nulls_last(), F.col("o_custkey").desc_nulls_last(), "o_orderkey").limit(40).select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date"))


@query("""SELECT p_partkey, coalesce(min_by(p_name, rank), CAST(p_partkey AS VARCHAR)) AS name FROM (SELECT p_partkey, unnest([p_type, p_brand, p_name]) AS p_name, unnest([2, CASE WHEN p_size % 3 = 0 THEN 0 ELSE 3 END, 1]) AS rank FROM part) GROUP BY p_partkey""")
def q_name_rank(spark, d):
    ranked = F.array(
        F.struct(F.lit(2).alias("rank"), F.col("p_type").alias("name")),
        F.struct(F.when(F.col("p_size") % 3 == 0, 0).otherwise(3).alias("rank"), F.col("p_brand").alias("name")),
        F.struct(F.lit(1).alias("rank"), F.col("p_name").alias("name")),
    )
    return t(spark, d, "part").select("p_partkey", F.coalesce(F.get(F.array_sort(ranked), F.lit(0))["name"], F.col("p_partkey").cast("string")).alias("name"))


@query("""SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n_ok, CAST(count(*) FILTER (o_orderstatus <> 'F') AS BIGINT) AS n_error,
 CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'ok' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'error' ELSE 'partial' END AS run_status,
 CASE WHEN count(DISTINCT o_orderpriority) = 0 THEN 'unlabeled' WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) ELSE 'mixed_weighting' END AS weighting FROM orders GROUP BY o_custkey""")
def q_run_status(spark, d):
    ok = F.col("o_orderstatus") == "F"
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), aggs.single_value(F.col("o_orderpriority")).alias("weighting"))
    return g.withColumn("run_status", F.when(F.col("n_error") == 0, "ok").when(F.col("n_ok") == 0, "error").otherwise("partial"))


@query("""SELECT r_name, latent, tpl, alpha, CAST(row_number() OVER (PARTITION BY r_name ORDER BY latent, tpl, alpha) - 1 AS INT) AS candidate FROM region, (SELECT unnest([1]) AS latent), (SELECT unnest([2, 3, 4]) AS tpl), (SELECT unnest([CAST(0.05 AS DOUBLE), CAST(0.1 AS DOUBLE)]) AS alpha)""")
def q_grid_product(spark, d):
    grid = F.explode(F.array(*(F.struct(F.lit(i).alias("candidate"), F.lit(1).alias("latent"), F.lit(k).alias("tpl"), F.lit(a).alias("alpha")) for i, (k, a) in enumerate((k, a) for k in (2, 3, 4) for a in (0.05, 0.1)))))
    return t(spark, d, "region").select("r_name", grid.alias("g")).select("r_name", "g.latent", "g.tpl", "g.alpha", "g.candidate")


@query("""SELECT n_name, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS segments, regexp_replace(regexp_replace(n_name || ' / ' || max(c_name) || '#', '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file_name FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def q_join_unique(spark, d):
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    g = c.join(joins.sized_broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("s"), F.max("c_name").alias("m"))
    return g.select("n_name", X.join_unique(F.col("s")).alias("segments"), X.safe_name(F.concat("n_name", F.lit(" / "), "m", F.lit("#"))).alias("file_name"))


@query("""WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS n_docs, CAST(count(DISTINCT lang) AS BIGINT) AS n_langs, min(lang) AS first_lang, max(lang) AS last_lang FROM s GROUP BY source""")
def q_selected_documents(spark, d):
    g = t(spark, d, "documents").select("doc_id", "source", "lang").distinct()
    return g.groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct("lang").alias("n_langs"), F.min("lang").alias("first_lang"), F.max("lang").alias("last_lang"))


@query("""SELECT d.source, CAST(sum(CASE WHEN l.toxic IS NULL THEN 0 ELSE l.toxic END) AS BIGINT) AS toxic_sum, coalesce(bool_or(l.quality = 1), false) AS any_good, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def q_conditional_sums(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(aggs.zero_sum(F.col("toxic").cast("long")).alias("toxic_sum"), F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("any_good"), F.count("*").alias("n"))
