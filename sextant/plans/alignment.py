"""The alignment study end to end: speeches, party mapping, bridge to programmes, topics, distances, panel, regression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as X
from ..functions import vectors as V
from ..operators import aggs, joins, panel, regression
from ..operators import topics as T
from ..sources.files import require_columns, union_tables


#: How a programme was chosen.
SELECTION = ("latest_manifesto_on_or_before_speech_date", "fallback_to_earliest_manifesto")


def regular_speeches(extract: DataFrame, value: str = "text") -> DataFrame:
    """Speeches of regular members with a party, a value and a date that can be read; with month and month_start."""
    require_columns(extract, ["content_kind", "speaker_type", "party", "date", value])
    rows = extract.filter((F.col("content_kind") == "speech") & (F.col("speaker_type") == "regular"))
    rows = rows.withColumns({"party": F.trim("party"), value: F.trim(value), "date": D.parse_iso_date(F.col("date").cast("string"))})
    rows = rows.dropna(subset=["party", value, "date"]).filter((F.col("party") != "") & (F.col(value) != ""))
    return rows.withColumns({"month": D.month(F.col("date")), "month_start": D.month_start(F.col("date"))})


def _named(catalogue: DataFrame, key, name: str) -> DataFrame:
    """key -> the one party it names with its first name, or null and a note of all candidates."""
    each = catalogue.withColumn("key", key).filter("key <> ''").groupBy("key", F.col("party").cast("long").alias("entity")).agg(F.min(name).alias("name"))
    all_of = F.sort_array(F.collect_list(F.struct("entity", "name")))  # parties of one label
    t = each.groupBy("key").agg(all_of.alias("all"))
    told = F.array_join(F.transform("all", lambda c: F.concat_ws(":", c["entity"].cast("string"), c["name"])), "; ")
    hit = F.get("all", F.lit(0))
    return t.select("key", F.when(F.size("all") == 1, F.struct(hit["name"].alias("name"), hit["entity"].alias("entity"))).alias("hit"), F.when(F.size("all") > 1, F.concat(F.lit("Ambiguous MPDS match candidates: "), told)).alias("note"))


def _by_hand(manual: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(alias, party, partyname, note): the party's row of the preferred name, else its first. A party that the catalogue lacks is
    an error."""
    joins.require_matched(manual, catalogue, ["party"])
    wanted = F.col("preferred_partyname") if "preferred_partyname" in manual.columns else F.lit(None).cast("string")
    note = F.col("note") if "note" in manual.columns else F.lit("")
    rows = manual.select("alias", "party", wanted.alias("wanted"), F.coalesce(note, F.lit("")).alias("note")).join(catalogue, "party")
    best = F.struct(F.when(F.col("partyname") == F.col("wanted"), 0).otherwise(1), "partyname")
    return rows.groupBy("alias", "party").agg(F.min_by("partyname", best).alias("partyname"), F.min("note").alias("note"))


def party_mapping(speeches: DataFrame, catalogue: DataFrame, manual: DataFrame | None = None, country: str = "", country_name: str = "", known: Mapping[str, tuple[str, str]] = {}) -> DataFrame:
    """Every party label with the catalogue's party (columns party, partyname, partyabbrev) that it names: by hand (manual: alias,
    party, and if given preferred_partyname and note), else by abbreviation or name, as written and then without accents and
    punctuation. known: labels that are no parties, with their type and note."""
    labels = speeches.filter(F.trim("party") != "").groupBy(F.col("party").alias("speech_party")).agg(F.count("*").alias("n_rows"))
    named = catalogue.select("party", "partyname", "partyabbrev").distinct()
    canonical = lambda c: X.canonical_label(F.col(c))
    labels = labels.withColumns({"speech_party_norm": X.normalized(F.col("speech_party")), "speech_party_canonical": canonical("speech_party")})
    norm, canon = F.col("speech_party_norm"), F.col("speech_party_canonical")
    steps = []
    if manual is not None:
        rows = _by_hand(manual, named)
        hit = F.struct(F.col("partyname").alias("name"), F.col("party").cast("long").alias("entity"))
        by_hand = lambda key: rows.groupBy(key.alias("key")).agg(F.min(hit).alias("hit"), F.min("note").alias("note"))
        steps = [("manual_alias", F.col("speech_party"), by_hand(F.col("alias"))), ("manual_alias", norm, by_hand(X.normalized(F.col("alias")))), ("manual_alias", canon, by_hand(canonical("alias")))]
    steps += [
        ("exact_abbrev", norm, _named(named, X.normalized(F.col("partyabbrev")), "partyname")),
        ("exact_name", norm, _named(named, X.normalized(F.col("partyname")), "partyname")),
        ("canonical_abbrev", canon, _named(named, canonical("partyabbrev"), "partyname")),
        ("canonical_name", canon, _named(named, canonical("partyname"), "partyname")),
    ]
    found = joins.cascade_lookup(labels, "speech_party", steps)
    abbreviations = named.groupBy(F.col("party").cast("long").alias("entity"), F.col("partyname").alias("entity_name")).agg(F.min("partyabbrev").alias("partyabbrev"))
    found = found.join(joins.sized_broadcast(abbreviations), ["entity", "entity_name"], "left").withColumn("speech_label_type", X.label_type(F.col("speech_party"), country, known))
    is_mapped, kind = F.col("entity").isNotNull(), F.col("speech_label_type")
    note = F.when(is_mapped & (F.col("method") == "manual_alias"), F.coalesce("note", F.lit(""))).when(is_mapped, "").otherwise(F.coalesce("note", X.unmapped_note(F.col("speech_party"), kind, country, country_name, known)))
    return found.select(
        *("speech_party", "speech_party_norm", "speech_party_canonical", "speech_label_type", "n_rows"),
        F.when(is_mapped, "mapped").otherwise("unmapped").alias("mapping_status"),
        F.when(is_mapped, F.col("method")).otherwise("").alias("match_method"),
        F.col("entity").alias("mpds_party_id"),
        F.col("entity_name").alias("mpds_partyname"),
        F.col("partyabbrev").alias("mpds_partyabbrev"),
        note.alias("mapping_note"),
    )


def mapping_reports(mapping: DataFrame) -> dict[str, DataFrame]:
    """Labels without a party: all, those that name parties, and those that name something else in parliament."""
    rows = mapping.filter("mapping_status = 'unmapped'").select("speech_party", "speech_label_type", "n_rows", "mapping_note")
    party = F.col("speech_label_type") == "party"
    return {"unmapped_labels": rows.orderBy("speech_label_type", "speech_party"), "real_parties": rows.filter(party).orderBy("speech_party"), "parliamentary_labels": rows.filter(~party).orderBy("speech_label_type", "speech_party")}


def programmes(catalogue: DataFrame, country: str) -> DataFrame:
    """Dated programmes of a country's parties; those without a usable date are left out."""
    rows = catalogue.filter(F.col("countryname") == country).dropna(subset=["party", "date"])
    ym = F.col("date").cast("int").cast("string")
    rows = rows.withColumn("manifesto_effective_date", D.parse_effective_date(F.col("edate"), ym))
    doc_key = F.concat_ws("_", F.col("party").cast("int").cast("string"), ym)
    out = rows.select(F.col("party").cast("int").alias("mpds_party_id"), "partyname", "partyabbrev", F.col("date").cast("int").alias("manifesto_date"), "edate", "manifesto_effective_date", doc_key.alias("doc_key"))
    return out.dropna(subset=["manifesto_effective_date"]).distinct()


def date_bridge(speeches: DataFrame, mapping: DataFrame, documents: DataFrame) -> DataFrame:
    """Each party and date of speech with the programme in force, or the party's earliest."""
    dates = speeches.groupBy(F.col("party").alias("speech_party"), "date", "month", "month_start").agg(F.count("*").alias("speech_rows"))
    mapped = mapping.filter("mapping_status = 'mapped'").select("speech_party", "speech_label_type", "mpds_party_id", "mpds_partyname", "mpds_partyabbrev")
    dates = dates.join(joins.sized_broadcast(mapped), "speech_party").withColumn("mpds_party_id", F.col("mpds_party_id").cast("int"))
    columns = [c for c in documents.columns if c not in ("mpds_party_id", "manifesto_effective_date")]
    return joins.asof_join(dates, documents, ["mpds_party_id"], "date", "manifesto_effective_date", columns, tie=["doc_key"], fallback=True, methods=SELECTION)


def month_bridge(bridge: DataFrame, null_keys: str = "drop") -> DataFrame:
    keys = [c for c in bridge.columns if c not in ("date", "speech_rows")]
    return aggs.grouped(bridge, keys, null_keys).agg(F.sum("speech_rows").alias("speech_rows"), F.countDistinct("date").alias("speech_dates"), F.min("date").alias("speech_start_date"), F.max("date").alias("speech_end_date"))


def party_month_topics(topics: DataFrame, weighting: str = "log_word_count", vector: str = "topics") -> DataFrame:
    """Mean topic shares by party and month. topics: party, month, month_start, word_count and the shares."""
    weight = {"unweighted": F.lit(1.0), "word_count": F.col("word_count").cast("double"), "log_word_count": F.log1p("word_count")}[weighting]
    keys = ["party", "month", "month_start"]
    return aggs.as_vectors(aggs.mean_vector(topics, keys, vector, weight), keys, "topics").withColumn("speech_topic_weighting", F.lit(weighting))


def align(speech: DataFrame, programme: DataFrame, bridge: DataFrame) -> DataFrame:
    """Distances of party-months to the programmes that the bridge gives. speech: party, month, month_start, topics; programme:
    doc_key, topics."""
    a = joins.validated_join(bridge, speech.withColumnRenamed("party", "speech_party").withColumnRenamed("topics", "topics_speech"), ["speech_party", "month", "month_start"], validate="many_to_one")
    b = joins.validated_join(a, programme.select("doc_key", F.col("topics").alias("topics_manifesto")), ["doc_key"], validate="many_to_one")
    p, q = V.clipped_normalized(F.col("topics_speech")), V.clipped_normalized(F.col("topics_manifesto"))
    b = b.withColumns({"_p": p, "_q": q})
    x, y = F.col("_p"), F.col("_q")
    return b.withColumns({"js_distance": V.js_distance(x, y), "cosine_similarity": V.cosine(x, y), "hellinger_distance": V.hellinger(x, y)}).withColumn("alignment_score", 1 - F.col("js_distance")).drop("_p", "_q")


#: The panel's leading columns.
LEADING = (
    "speech_party month month_start analysis_date alignment_score js_distance cosine_similarity hellinger_distance speech_topic_weighting "
    "speech_volume_segments speech_volume_words log1p_speech_segments log1p_speech_words speech_segment_share speech_word_share "
    "last_election_id last_election_date next_election_id next_election_date cycle_next_election_date cycle_boundary_source "
    "days_since_last_election days_until_cycle_end cycle_length_days electoral_cycle_progress electoral_cycle_remaining "
    "party_seats party_seat_share party_has_absolute_majority party_vote_share party_seat_source speech_party_is_coalition "
    "cabinet_id cabinet_name cabinet_start_date cabinet_next_start_date cabinet_caretaker cabinet_party_count cabinet_is_coalition "
    "cabinet_gov_seats cabinet_gov_seat_share cabinet_has_absolute_majority cabinet_context_source cabinet_context_note "
    "party_in_government party_prime_minister party_government_status"
).split()


@dataclass(frozen=True)
class Parliament:
    """Tables of one country. composition: election_id, party_id, seats, parliament_composition_date; results: election_id,
    party_id, seats, vote_share; cabinets, cabinet_parties and overrides as panel.cabinet_context takes them; parties:
    speech_party, party_id, speech_party_is_coalition."""

    composition: DataFrame
    results: DataFrame
    cabinets: DataFrame
    cabinet_parties: DataFrame
    parties: DataFrame
    overrides: DataFrame | None = None


def leading(df: DataFrame, columns: Sequence[str] = LEADING) -> DataFrame:
    """The columns that are there of those named first, then the others."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first))


def model_columns(df: DataFrame) -> DataFrame:
    """Without topic shares."""
    return df.select(*(c for c in df.columns if not c.startswith(("topic_", "topics"))))


def with_cycle(df: DataFrame, elections: DataFrame) -> DataFrame:
    """Adds the electoral cycle at analysis_date. elections: date, and if given election_id and seats_total."""
    dated = elections.withColumn("last_election_date", F.col("date").cast("timestamp")).filter("last_election_date is not null")
    cycle = panel.election_cycle(df, dated, [], "analysis_date", "last_election_date")
    cycle = cycle.withColumn("cycle_next_election_date", F.col("cycle_end")).withColumnRenamed("next_last_election_date", "next_election_date").drop("cycle_end")
    if "election_id" not in elections.columns:
        return cycle
    by_date = dated.groupBy("last_election_date").agg(F.min("election_id").alias("last_election_id"), F.max("seats_total").alias("election_seats_total"))
    following = by_date.select(F.col("last_election_date").alias("next_election_date"), F.col("last_election_id").alias("next_election_id"))
    return cycle.join(joins.sized_broadcast(by_date), "last_election_date", "left").join(joins.sized_broadcast(following), "next_election_date", "left")


def regression_panel(aligned: DataFrame, speeches: DataFrame, elections: DataFrame, parliament: Parliament | None = None) -> DataFrame:
    """Party-months with the electoral cycle, the volume of speech and, where its tables are given, seats and cabinets."""
    at = D.midpoint(F.col("speech_start_date"), F.col("speech_end_date"), F.col("month_start"))
    out = with_cycle(aligned.withColumn("analysis_date", at).filter("analysis_date is not null"), elections)
    if parliament is not None:
        parties = parliament.parties.select("speech_party", "party_id", "speech_party_is_coalition")
        seats = panel.seat_panel(parliament.composition.join(parties, "party_id"), parliament.results.join(parties, "party_id"), ["election_id", "speech_party"])
        out = panel.with_seats(out, seats.withColumnRenamed("election_id", "last_election_id"), ["last_election_id", "speech_party"], "election_seats_total")
        out = panel.cabinet_context(out, parliament.cabinets, parliament.cabinet_parties, parties, parliament.overrides)
    said = speeches.select(F.col("party").alias("speech_party"), "month", X.word_count(F.col("text")).alias("_words"))
    out = panel.with_volume(out, said, ["speech_party"], "month", "_words", "speech_rows")
    return leading(out.orderBy("month_start", "speech_party"))


def pooled(panels: dict[str, DataFrame]) -> DataFrame:
    return union_tables(panels, "country_code")


def run(speech_extract: DataFrame, catalogue: DataFrame, sentences: DataFrame, elections: DataFrame, country: str, params: T.Params = T.Params(), predictors: Sequence[str] = ("electoral_cycle_progress", "log1p_speech_words"), weighting: str = "log_word_count", iterations: int = 240, parliament: Parliament | None = None, manual: DataFrame | None = None, known: Mapping[str, tuple[str, str]] = {}, code: str = "") -> dict:
    """All stages for one country. sentences: doc_key, quasi_sentence_id, text. Returns the tables, the topic model and the fit."""
    speeches = regular_speeches(speech_extract).withColumn("speech_no", F.xxhash64("party", "date", "text"))
    mapping = party_mapping(speeches, catalogue.filter(F.col("countryname") == country), manual, code or country, country, known)
    bridge = date_bridge(speeches, mapping, programmes(catalogue, country))
    model = T.fit_labelled(speeches, "speech_no", "text", "topic_label", ["date", "speech_no"], params, iterations)
    shares = T.infer_labelled(speeches.dropna(subset=["topic_label"]), "speech_no", "text", model, "topic_label")
    keyed = speeches.select("speech_no", "party", "month", "month_start", X.word_count(F.col("text")).alias("word_count")).dropDuplicates(["speech_no"])
    by_month = party_month_topics(shares.join(keyed, "speech_no"), weighting)
    said = sentences.withColumn("sentence", F.concat_ws("#", "doc_key", F.col("quasi_sentence_id").cast("string")))
    read = T.infer_labelled(said, "sentence", "text", model).join(said.select("sentence", "doc_key"), "sentence")
    programme = aggs.as_vectors(aggs.mean_vector(read, ["doc_key"], "topics"), ["doc_key"], "topics")
    months = month_bridge(bridge, "keep")
    aligned = align(by_month, programme, months)
    rows = regression_panel(aligned, speeches, elections, parliament)
    try:
        fit = regression.fit_ols(rows, "alignment_score", list(predictors), ["speech_party"])
    except ValueError as e:  # too few rows for the parameters
        fit = e
    return {"mapping": mapping, "bridge": bridge, "month_bridge": months, "model": model, "speech_topics": by_month, "manifesto_topics": programme, "alignment": aligned, "panel": rows, "fit": fit}
