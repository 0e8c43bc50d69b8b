"""Queries over the parts of the alignment study: party mapping, seats, cabinets, volume of speech, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import panel
from . import alignment
from .catalog import query, r6, t

KNOWN = {"Group 0": ("parliamentary_group", "A group of members."), "Group 1": ("group", "Another group.")}
LABELS = """labels AS (SELECT CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) WHEN 2 THEN 'N-' || (n_nationkey % 20) WHEN 3 THEN 'n' || (n_nationkey % 20) WHEN 4 THEN 'Alias.' || (n_nationkey % 3) ELSE 'Group ' || (n_nationkey % 4) END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey),
counts AS (SELECT label AS speech_party, upper(trim(label)) AS norm, regexp_replace(upper(label), '[^A-Z0-9]', '', 'g') AS canon, count(*) AS n_rows FROM labels GROUP BY ALL),
named AS (SELECT n_nationkey AS party, n_name AS partyname, 'N' || (n_nationkey % 20) AS partyabbrev FROM nation),
manual(alias, party, note) AS (VALUES ('Alias.0', 3, 'by hand'), ('alias 1', 24, '')),
keys AS (SELECT 'exact_abbrev' AS method, 1 AS step, upper(trim(partyabbrev)) AS key, * FROM named UNION ALL SELECT 'exact_name', 2, upper(trim(partyname)), * FROM named UNION ALL SELECT 'canonical_abbrev', 3, regexp_replace(upper(partyabbrev), '[^A-Z0-9]', '', 'g'), * FROM named UNION ALL SELECT 'canonical_name', 4, regexp_replace(upper(partyname), '[^A-Z0-9]', '', 'g'), * FROM named),
lookup AS (SELECT method, step, key, count(DISTINCT party) AS n, min(party) AS party, 'Ambiguous MPDS match candidates: ' || string_agg(party || ':' || partyname, '; ' ORDER BY party) AS note FROM keys GROUP BY ALL),
tried AS (SELECT speech_party, step, method, n, party, note FROM counts JOIN lookup ON key = CASE WHEN step <= 2 THEN norm ELSE canon END),
hand AS (SELECT speech_party, party, manual.note FROM counts JOIN manual ON speech_party = alias OR norm = upper(trim(alias)) OR canon = regexp_replace(upper(alias), '[^A-Z0-9]', '', 'g')),
best AS (SELECT speech_party, min_by(method, step) FILTER (n = 1) AS method, min_by(party, step) FILTER (n = 1) AS party, min_by(note, step) FILTER (n > 1) AS note FROM tried GROUP BY 1),
mapping AS (SELECT c.speech_party, norm AS speech_party_norm, canon AS speech_party_canonical, CASE c.speech_party WHEN 'Group 0' THEN 'parliamentary_group' WHEN 'Group 1' THEN 'group' ELSE 'party' END AS speech_label_type, CAST(n_rows AS BIGINT) AS n_rows,
 CASE WHEN coalesce(h.party, b.party) IS NULL THEN 'unmapped' ELSE 'mapped' END AS mapping_status, CASE WHEN h.party IS NOT NULL THEN 'manual_alias' ELSE coalesce(b.method, '') END AS match_method, CAST(coalesce(h.party, b.party) AS BIGINT) AS mpds_party_id, partyname AS mpds_partyname, partyabbrev AS mpds_partyabbrev,
 CASE WHEN h.party IS NOT NULL THEN h.note WHEN b.party IS NOT NULL THEN '' ELSE coalesce(b.note, CASE c.speech_party WHEN 'Group 0' THEN 'A group of members.' WHEN 'Group 1' THEN 'Another group.' ELSE 'Party label present in QQ parliamentary speeches but not mapped to an MPDS Nations party.' END) END AS mapping_note
 FROM counts c LEFT JOIN hand h ON c.speech_party = h.speech_party LEFT JOIN best b ON c.speech_party = b.speech_party LEFT JOIN named ON named.party = coalesce(h.party, b.party))"""


def mapping(spark, d):
    n = t(spark, d, "nation")
    k = F.col("n_nationkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    case = F.col("c_custkey") % 6
    label = F.when(case == 0, F.col("n_name")).when(case == 1, text(" ", F.lower("n_name"))).when(case == 2, text("N-", k % 20)).when(case == 3, text("n", k % 20)).when(case == 4, text("Alias.", k % 3)).otherwise(text("Group ", k % 4))
    speeches = t(spark, d, "customer").join(n, F.col("c_nationkey") == k).select(label.alias("party"))
    catalogue = n.select(k.alias("party"), F.col("n_name").alias("partyname"), text("N", k % 20).alias("partyabbrev"))
    manual = spark.createDataFrame([("Alias.0", 3, "by hand"), ("alias 1", 24, "")], "alias string, party int, note string")
    return alignment.party_mapping(speeches, catalogue, manual, "QQ", "Nations", KNOWN)


@query(f"WITH {LABELS} SELECT * FROM mapping")
def q_party_mapping(spark, d):
    """The eleven columns of a mapping of labels to parties."""
    return mapping(spark, d)


@query(f"""WITH {LABELS}, u AS (SELECT speech_party, speech_label_type, n_rows, mapping_note FROM mapping WHERE mapping_status = 'unmapped')
SELECT 'unmapped_labels' AS report, * FROM u UNION ALL SELECT 'real_parties', * FROM u WHERE speech_label_type = 'party' UNION ALL SELECT 'parliamentary_labels', * FROM u WHERE speech_label_type <> 'party'""")
def q_mapping_reports(spark, d):
    reports = alignment.mapping_reports(mapping(spark, d))
    parts = [df.select(F.lit(name).alias("report"), "*") for name, df in reports.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


TOPICS = list(X.BROAD_TOPICS)
LABELLED = "list_value('ф' || p_brand, 'Група ' || p_brand, 'бЛок', p_name, 'A-frakció')[1 + p_partkey % 5]"
CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.BROAD_TOPICS.items())
NAMES = ", ".join(f"'{k}'" for k in [*TOPICS, "Unknown"])


@query(f"""WITH l AS (SELECT p_partkey, {LABELLED} AS label, list_value({NAMES})[1 + p_partkey % {len(TOPICS) + 1}] AS topic FROM part),
k AS (SELECT *, CASE WHEN starts_with(lower(label), 'ф') THEN 'faction' WHEN starts_with(lower(label), 'г') THEN 'group' WHEN starts_with(lower(label), 'б') THEN 'bloc' ELSE 'party' END AS ua, CASE WHEN ends_with(label, '-frakció') THEN 'faction' ELSE 'party' END AS hu FROM l)
SELECT p_partkey, ua AS ua_type, hu AS hu_type, CASE ua WHEN 'group' THEN '{X.UNMAPPED_NOTES["group"]}' WHEN 'faction' THEN '{X.UNMAPPED_NOTES["faction"]}' WHEN 'bloc' THEN '{X.UNMAPPED_NOTES["bloc"]}' ELSE 'Party label present in UA parliamentary speeches but not mapped to an MPDS Ukraine party.' END AS ua_note, topic, CASE topic {CASES} END AS broad_topic FROM k""")
def q_label_rules(spark, d):
    """Types and notes of labels by the countries' rules, and broad topics."""
    b = F.col("p_brand")
    label = F.get(F.array(F.concat(F.lit("ф"), b), F.concat(F.lit("Група "), b), F.lit("бЛок"), F.col("p_name"), F.lit("A-frakció")), (F.col("p_partkey") % 5).cast("int"))
    topic = F.get(F.array(*(F.lit(x) for x in [*TOPICS, "Unknown"])), (F.col("p_partkey") % (len(TOPICS) + 1)).cast("int"))
    rows = t(spark, d, "part").select("p_partkey", label.alias("label"), topic.alias("topic"))
    rows = rows.withColumns({"ua_type": X.label_type(F.col("label"), "UA"), "hu_type": X.label_type(F.col("label"), "HU")})
    note = X.unmapped_note(F.col("label"), F.col("ua_type"), "UA", "Ukraine")
    return rows.select("p_partkey", "ua_type", "hu_type", note.alias("ua_note"), "topic", X.broad_topic(F.col("topic")).alias("broad_topic"))


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS election_id, o_orderpriority AS speech_party, o_orderstatus AS status, CAST(o_orderkey % 3 AS DOUBLE) AS seats, o_totalprice / 1e6 AS vote, CAST(o_orderdate AS DATE) AS date FROM orders),
a AS (SELECT election_id, speech_party, sum(seats) AS seats, min(date) AS first_date, max(date) >= DATE '1999-07-01' AS coalition FROM o WHERE status = 'F' AND speech_party <> '5-LOW' GROUP BY ALL),
b AS (SELECT election_id, speech_party, sum(seats) AS seats, sum(vote) AS vote FROM o WHERE status = 'O' AND election_id <> 1996 GROUP BY ALL),
m AS (SELECT election_id, speech_party, sum(seats) AS total FROM o GROUP BY ALL)
SELECT m.election_id, m.speech_party, coalesce(a.seats, b.seats) AS party_seats, CASE WHEN a.seats IS NOT NULL THEN 'parliament_composition' WHEN b.seats IS NOT NULL THEN 'election_result' END AS party_seat_source, round(b.vote, 4) AS party_vote_share, first_date AS parliament_composition_date, coalition AS speech_party_is_coalition,
 round(coalesce(a.seats, b.seats) / nullif(total, 0), 6) AS party_seat_share, coalesce(coalesce(a.seats, b.seats) > total / 2, false) AS party_has_absolute_majority FROM m LEFT JOIN a USING (election_id, speech_party) LEFT JOIN b USING (election_id, speech_party)""")
def q_panel_seats(spark, d):
    """Seats by the composition, else by the result, with shares and majorities."""
    o = t(spark, d, "orders").select(F.year("o_orderdate").alias("election_id"), F.col("o_orderpriority").alias("speech_party"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).cast("double").alias("seats"), (F.col("o_totalprice") / 1e6).alias("vote_share"), F.col("o_orderdate").cast("date").alias("parliament_composition_date"))
    o = o.withColumn("speech_party_is_coalition", F.col("parliament_composition_date") >= F.to_date(F.lit("1999-07-01")))
    seats = panel.seat_panel(o.filter("status = 'F' and speech_party <> '5-LOW'"), o.filter("status = 'O' and election_id <> 1996"), ["election_id", "speech_party"])
    rows = o.groupBy("election_id", "speech_party").agg(F.sum("seats").alias("total"))
    out = panel.with_seats(rows, seats, ["election_id", "speech_party"], "total")
    found = F.when(F.col("party_seats").isNotNull(), F.col("party_seat_source"))
    return out.select("election_id", "speech_party", "party_seats", found.alias("party_seat_source"), F.round("party_vote_share", 4).alias("party_vote_share"), "parliament_composition_date", "speech_party_is_coalition", r6(F.col("party_seat_share")).alias("party_seat_share"), "party_has_absolute_majority")


@query("""WITH q AS (SELECT CAST(year(o_orderdate) * 10 + quarter(o_orderdate) AS BIGINT) AS cabinet_id, o_orderdate AS tm, o_orderpriority AS party, o_orderkey AS k FROM orders),
c AS (SELECT cabinet_id, min(tm) AS start, CAST(cabinet_id % 3 = 0 AS INT) AS caretaker, CAST(count(*) AS DOUBLE) AS total FROM q WHERE cabinet_id % 10 <> 2 GROUP BY cabinet_id),
n AS (SELECT *, lead(start) OVER (ORDER BY start) AS next_start FROM c),
p AS (SELECT cabinet_id, party, CAST(cabinet_id % 3 <> 0 AND (ascii(party) + cabinet_id) % 2 = 0 AS INT) AS member, CAST((ascii(party) + cabinet_id) % 10 = 4 AS INT) AS prime, CAST(count(*) AS DOUBLE) AS seats FROM q GROUP BY ALL),
s AS (SELECT cabinet_id, count(DISTINCT party) FILTER (member = 1) AS parties, coalesce(sum(seats) FILTER (member = 1), 0) AS gov FROM p GROUP BY 1),
l AS (SELECT DISTINCT party, date_trunc('month', tm) AS month FROM q),
x AS (SELECT l.party, l.month, n.* FROM l ASOF LEFT JOIN n ON l.month >= n.start),
r AS (SELECT x.*, parties, gov, coalesce(member, 0) AS member, coalesce(prime, 0) AS prime, coalesce(seats, 0) AS seats, x.cabinet_id = 19971 AND x.month >= TIMESTAMP '1997-02-01' AND x.month < TIMESTAMP '1997-06-01' AS o FROM x LEFT JOIN s USING (cabinet_id) LEFT JOIN p ON p.cabinet_id = x.cabinet_id AND p.party = x.party),
f AS (SELECT party, month, cabinet_id, total, caretaker, CASE WHEN o THEN 2 ELSE parties END AS parties, CASE WHEN o THEN 7.0 ELSE gov END AS gov, CASE WHEN o THEN CAST(party IN ('1-URGENT', '2-HIGH') AS INT) ELSE member END AS member, CASE WHEN o THEN CAST(party = '2-HIGH' AS INT) ELSE prime END AS prime,
 CASE WHEN o THEN CASE WHEN party IN ('1-URGENT', '2-HIGH') THEN 7.0 ELSE 0 END ELSE seats END AS seats, CASE WHEN o THEN 'parlgov_with_sourced_override' ELSE 'parlgov' END AS source, CASE WHEN o THEN 'interim' ELSE '' END AS note FROM r)
SELECT party AS speech_party, CAST(month AS DATE) AS month, cabinet_id, CAST(parties AS BIGINT) AS cabinet_party_count, parties > 1 AS cabinet_is_coalition, CAST(gov AS DOUBLE) AS cabinet_gov_seats, round(gov / total, 6) AS cabinet_gov_seat_share, coalesce(gov > total / 2, false) AS cabinet_has_absolute_majority, CAST(member AS INT) AS party_in_government, CAST(prime AS INT) AS party_prime_minister, CAST(seats AS DOUBLE) AS party_cabinet_seats, source AS cabinet_context_source, note AS cabinet_context_note,
 CASE WHEN prime = 1 THEN 'prime_minister_party' WHEN member = 1 THEN 'coalition_partner' WHEN caretaker = 1 AND coalesce(parties, 0) = 0 THEN 'nonpartisan_caretaker' ELSE 'opposition' END AS party_government_status FROM f""")
def q_cabinet_context(spark, d):
    """The cabinet in office by party and month, with an override for some of its time."""
    o = t(spark, d, "orders").select((F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("long").alias("cabinet_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("party_id"))
    cabinets = o.filter("cabinet_id % 10 <> 2").groupBy("cabinet_id").agg(F.min("at").alias("cabinet_start_date"), F.count("*").cast("double").alias("cabinet_election_seats_total"))
    cabinets = cabinets.withColumn("cabinet_caretaker", (F.col("cabinet_id") % 3 == 0).cast("int"))
    place = F.ascii("party_id") + F.col("cabinet_id")
    parties = o.groupBy("cabinet_id", "party_id").agg(F.count("*").cast("double").alias("seats")).withColumns({"parlgov_party_short": F.col("party_id"), "cabinet_party": ((F.col("cabinet_id") % 3 != 0) & (place % 2 == 0)).cast("int"), "prime_minister": (place % 10 == 4).cast("int")})
    mapping = o.select(F.col("party_id").alias("speech_party"), "party_id").distinct()
    rows = o.select(F.col("party_id").alias("speech_party"), F.date_trunc("month", "at").alias("analysis_date")).distinct()
    rules = spark.createDataFrame([(19971, "1997-02-01", "1997-06-01", ["1-URGENT", "2-HIGH"], "2-HIGH", 7.0, "interim")], "cabinet_id long, start string, end string, governing_parties array<string>, prime_minister_party string, cabinet_gov_seats double, note string")
    rules = rules.withColumns({"start": F.col("start").cast("timestamp"), "end": F.col("end").cast("timestamp")})
    out = panel.cabinet_context(rows, cabinets, parties, mapping, rules)
    columns = "cabinet_id cabinet_party_count cabinet_is_coalition cabinet_gov_seats cabinet_gov_seat_share cabinet_has_absolute_majority party_in_government party_prime_minister party_cabinet_seats cabinet_context_source cabinet_context_note party_government_status".split()
    return out.select("speech_party", F.col("analysis_date").cast("date").alias("month"), *(r6(F.col(c)).alias(c) if c == "cabinet_gov_seat_share" else c for c in columns))


@query("""WITH s AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(user_id % 9 AS BIGINT) AS words FROM events WHERE value > 5),
v AS (SELECT event_type, day, count(*) AS n, sum(words) AS w FROM s GROUP BY ALL), m AS (SELECT day, sum(n) AS tn, sum(w) AS tw FROM v GROUP BY day),
l AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS speech_rows FROM events GROUP BY ALL),
x AS (SELECT l.*, CAST(coalesce(n, speech_rows) AS BIGINT) AS segments, CAST(coalesce(w, 0) AS BIGINT) AS words, tn, tw FROM l LEFT JOIN v USING (event_type, day) LEFT JOIN m ON m.day = l.day)
SELECT event_type AS speech_party, day AS month, segments AS speech_volume_segments, words AS speech_volume_words, round(ln(1 + segments), 6) AS log1p_speech_segments, round(ln(1 + words), 6) AS log1p_speech_words, round(segments / nullif(tn, 0), 6) AS speech_segment_share, round(words / nullif(tw, 0), 6) AS speech_word_share FROM x""")
def q_speech_volume(spark, d):
    """Volume of speech by party and period, filled where there is none."""
    e = t(spark, d, "events").select(F.col("event_type").alias("speech_party"), F.date_format("ts", "yyyy-MM-dd").alias("month"), "value", (F.col("user_id") % 9).alias("words"))
    rows = e.groupBy("speech_party", "month").agg(F.count("*").alias("speech_rows"))
    out = panel.with_volume(rows, e.filter("value > 5"), ["speech_party"], "month", "words", "speech_rows")
    rounded = ("log1p_speech_segments", "log1p_speech_words", "speech_segment_share", "speech_word_share")
    return out.select("speech_party", "month", "speech_volume_segments", "speech_volume_words", *(r6(F.col(c)).alias(c) for c in rounded))
