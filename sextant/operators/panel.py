"""Covariates of party-period panels: election cycles, terms of office, seats, cabinets, activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import floor_days
from .joins import asof_join, sized_broadcast


def median_gap_days(dates: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """by, gap_days: the median of the days between successive distinct dates, rounded half to even."""
    w = Window.partitionBy(*by).orderBy(date)
    gaps = dates.select(*by, date).distinct().withColumn("_gap", floor_days(F.col(date), F.lag(date).over(w)))
    return gaps.groupBy(*by).agg(F.bround(F.median("_gap")).cast("int").alias("gap_days"))


def election_cycle(left: DataFrame, elections: DataFrame, by: Sequence[str], at: str, date: str) -> DataFrame:
    """Adds the last and next election, where the cycle ends (the next, or the last plus the median gap), days since and until,
    and progress in [0, 1]. Rows before the first election have none of these."""
    found = asof_join(left, elections.select(*by, date).distinct(), by, at, date, [], with_next=True)
    gaps = median_gap_days(elections, by, date)
    found = found.join(sized_broadcast(gaps), list(by), "left") if by else found.crossJoin(gaps)  # without groups: one row
    last, following = F.col(date), F.col(f"next_{date}")
    end = F.when(following.isNotNull(), following.cast("timestamp")).otherwise(F.timestamp_micros(F.unix_micros(last.cast("timestamp")) + F.col("gap_days") * F.lit(86_400_000_000)))
    found = found.withColumn("cycle_end", end).withColumn("cycle_boundary_source", F.when(following.isNotNull() | last.isNull(), "observed_next_election").otherwise("imputed_country_median_cycle"))
    since, until, length = floor_days(F.col(at), last), floor_days(F.col("cycle_end"), F.col(at)), floor_days(F.col("cycle_end"), last)
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))
    progress = F.when(length != 0, since / length)
    return found.withColumns(
        {"days_since_last_election": since, "days_until_cycle_end": until, "cycle_length_days": length, "electoral_cycle_progress": clip(progress), "electoral_cycle_remaining": clip(1 - progress)}
    ).drop("gap_days")


def terms_of_office(starts: DataFrame, by: Sequence[str], start: str) -> DataFrame:
    """Adds `valid_until`: the next start of the group."""
    return starts.withColumn("valid_until", F.lead(start).over(Window.partitionBy(*by).orderBy(start)))


def in_office(left: DataFrame, cabinets: DataFrame, by: Sequence[str], at: str, start: str, columns: Sequence[str], end: str | None = None) -> DataFrame:
    """The cabinet that started last at or before; null where it has ended."""
    extra = [*columns, *([end] if end else [])]
    found = asof_join(left, cabinets, by, at, start, extra)
    if end is None:
        return found
    ended = F.col(end).isNotNull() & (F.col(at) >= F.col(end))
    return found.withColumns({c: F.when(~ended, F.col(c)) for c in [start, *columns]})


def seats(composition: DataFrame, results: DataFrame, keys: Sequence[str], seat: str) -> DataFrame:
    """Seats from the parliament's composition, else from the election's result, with their source."""
    a = composition.groupBy(*keys).agg(F.coalesce(F.sum(seat), F.lit(0)).alias("_a"))
    b = results.groupBy(*keys).agg(F.coalesce(F.sum(seat), F.lit(0)).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("_a", "_b").alias("party_seats"), F.when(F.col("_a").isNotNull(), "parliament_composition").otherwise("election_result").alias("party_seat_source"))


def majority(value: Column, total: Column) -> Column:
    """Over half; false where unknown."""
    return F.coalesce(value > total / 2, F.lit(False))


def government_status(prime_minister: Column, in_cabinet: Column, caretaker: Column, cabinet_parties: Column) -> Column:
    return (
        F.when(F.coalesce(prime_minister, F.lit(0)) == 1, "prime_minister_party")
        .when(F.coalesce(in_cabinet, F.lit(0)) == 1, "coalition_partner")
        .when((F.coalesce(caretaker, F.lit(0)) == 1) & (F.coalesce(cabinet_parties, F.lit(0)) == 0), "nonpartisan_caretaker")
        .otherwise("opposition")
    )


def cabinet_summary(parties: DataFrame, cabinets: DataFrame, cabinet: str, party: str, is_member: Column, seat: str) -> DataFrame:
    """For every cabinet the number of member parties, their seats and whether it is a coalition; 0 where there is none."""
    s = parties.groupBy(cabinet).agg(F.countDistinct(F.when(is_member, F.col(party))).alias("n"), F.sum(F.when(is_member, F.col(seat))).alias("s"))
    out = cabinets.select(cabinet).distinct().join(s, cabinet, "left")
    return out.select(cabinet, F.coalesce("n", F.lit(0)).alias("cabinet_party_count"), F.coalesce("s", F.lit(0)).alias("cabinet_gov_seats"), (F.coalesce("n", F.lit(0)) > 1).alias("cabinet_is_coalition"))


def apply_overrides(df: DataFrame, rules: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """Values of rules (key, start, end and columns) for rows in the half-open window [start, end). A row that several rules
    cover takes the latest start's. The rules of a key, which are few, come to its rows as one array."""
    rule = F.struct(F.col("start"), F.col("end"), *(F.col(c).alias(f"o_{c}") for c in columns))
    packed = rules.groupBy(F.col(key).alias("_k")).agg(F.sort_array(F.collect_list(rule), asc=False).alias("_rules"))
    covers = lambda r: (F.col(at) >= r["start"]) & (r["end"].isNull() | (F.col(at) < r["end"]))
    found = df.join(sized_broadcast(packed), F.col(key) == F.col("_k"), "left").withColumn("_rule", F.get(F.filter("_rules", covers), F.lit(0)))
    return found.withColumns({c: F.coalesce(F.col(f"_rule.o_{c}"), F.col(c)) for c in columns}).select(*df.columns)


def activity(df: DataFrame, keys: Sequence[str], period: str, words: str) -> DataFrame:
    """Segments and words by group and period, with the period's totals over all groups."""
    out = df.groupBy(*keys, period).agg(F.count("*").alias("speech_volume_segments"), F.coalesce(F.sum(words), F.lit(0)).alias("speech_volume_words"))
    total = lambda c: F.sum(c).over(Window.partitionBy(period))
    return out.withColumns({"month_total_speech_segments": total("speech_volume_segments"), "month_total_speech_words": total("speech_volume_words")})


def with_volume(df: DataFrame, speeches: DataFrame, keys: Sequence[str], period: str, words: str, rows: str) -> DataFrame:
    """Adds the volume of speech: segments (where there is no speech, the column `rows`), words, log1p of both, and their shares
    of the period's totals over all groups of speeches."""
    volume = activity(speeches, keys, period, words)
    totals = volume.select(period, "month_total_speech_segments", "month_total_speech_words").distinct()
    out = df.join(volume.drop("month_total_speech_segments", "month_total_speech_words"), [*keys, period], "left").join(sized_broadcast(totals), period, "left")
    out = out.withColumns({"speech_volume_segments": F.coalesce("speech_volume_segments", rows), "speech_volume_words": F.coalesce("speech_volume_words", F.lit(0))})
    share = lambda x, total: F.when(F.col(total) != 0, F.col(x) / F.col(total))
    return out.withColumns(
        {
            "log1p_speech_segments": F.log1p("speech_volume_segments"),
            "log1p_speech_words": F.log1p("speech_volume_words"),
            "speech_segment_share": share("speech_volume_segments", "month_total_speech_segments"),
            "speech_word_share": share("speech_volume_words", "month_total_speech_words"),
        }
    )


def seat_panel(composition: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each election and party: seats from the parliament's composition, else from the result, with their source; the vote
    share; whether the party is a coalition (told by the composition only). composition and results: keys, seats, and
    parliament_composition_date and speech_party_is_coalition, or vote_share."""
    known = composition.groupBy(*keys).agg(F.min("parliament_composition_date").alias("parliament_composition_date"), F.max("speech_party_is_coalition").alias("speech_party_is_coalition"))
    shares = results.groupBy(*keys).agg(F.coalesce(F.sum("vote_share"), F.lit(0.0)).alias("party_vote_share"))
    return seats(composition, results, keys, "seats").join(known, list(keys), "left").join(shares, list(keys), "left")


def with_seats(df: DataFrame, panel: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """Adds a seat_panel's columns, the party's share of the seats and whether they are over half."""
    out = df.join(panel, list(keys), "left")
    return out.withColumns({"party_seat_share": F.when(F.col(total) != 0, F.col("party_seats") / F.col(total)), "party_has_absolute_majority": majority(F.col("party_seats"), F.col(total))})


def cabinet_context(df: DataFrame, cabinets: DataFrame, cabinet_parties: DataFrame, mapping: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Adds the cabinet in office at analysis_date, its parties, seats and majority, and the part of speech_party in it.

    cabinets: cabinet_id, cabinet_start_date and more; cabinet_parties: cabinet_id, party_id, parlgov_party_short,
    cabinet_party, prime_minister, seats; mapping: speech_party, party_id. overrides: cabinet_id, start, end (half-open) and
    governing_parties (array), prime_minister_party, cabinet_gov_seats, note: what holds in that time instead.
    """
    dated = terms_of_office(cabinets.dropna(subset=["cabinet_start_date"]), [], "cabinet_start_date").withColumnRenamed("valid_until", "cabinet_next_start_date")
    extra = [c for c in dated.columns if c != "cabinet_start_date"]
    out = asof_join(df, dated, [], "analysis_date", "cabinet_start_date", extra)
    ended = F.col("cabinet_next_start_date").isNotNull() & (F.col("analysis_date") >= F.col("cabinet_next_start_date"))
    out = out.withColumn("cabinet_id", F.when(~ended, F.col("cabinet_id")))
    named = cabinet_parties.withColumn("_member", (F.col("cabinet_party") == 1) & (F.col("parlgov_party_short") != "none"))
    out = out.join(sized_broadcast(cabinet_summary(named, cabinet_parties, "cabinet_id", "party_id", F.col("_member"), "seats")), "cabinet_id", "left")
    part = cabinet_parties.join(mapping.select("speech_party", "party_id"), "party_id").groupBy("cabinet_id", "speech_party")
    flag = lambda agg, c, name: F.coalesce(agg(c), F.lit(0)).cast("int").alias(name)
    part = part.agg(flag(F.max, "cabinet_party", "party_in_government"), flag(F.max, "prime_minister", "party_prime_minister"), F.sum("seats").cast("double").alias("party_cabinet_seats"), flag(F.sum, "cabinet_party", "party_constituents_in_government"))
    out = out.join(sized_broadcast(part), ["cabinet_id", "speech_party"], "left").na.fill(0, ["party_in_government", "party_prime_minister", "party_constituents_in_government"]).na.fill(0.0, ["party_cabinet_seats"])
    out = out.withColumn("cabinet_context_source", F.lit("parlgov")).withColumn("cabinet_context_note", F.lit(""))
    if overrides is not None:
        out = _overridden(out, overrides)
    total = F.col("cabinet_election_seats_total")
    out = out.withColumns({"cabinet_gov_seat_share": F.when(total != 0, F.col("cabinet_gov_seats") / total), "cabinet_has_absolute_majority": majority(F.col("cabinet_gov_seats"), total)})
    return out.withColumn("party_government_status", government_status(F.col("party_prime_minister"), F.col("party_in_government"), F.col("cabinet_caretaker"), F.col("cabinet_party_count")))


def _overridden(df: DataFrame, overrides: DataFrame) -> DataFrame:
    rules = overrides.select("cabinet_id", "start", "end", F.struct("governing_parties", "prime_minister_party", F.col("cabinet_gov_seats").cast("double").alias("seats"), "note").alias("_set"))
    kind = rules.schema["_set"].dataType
    out = apply_overrides(df.withColumn("_set", F.lit(None).cast(kind)), rules, "cabinet_id", "analysis_date", ["_set"])
    hit, parties = F.col("_set").isNotNull(), F.col("_set.governing_parties")
    governs = F.array_contains(parties, F.col("speech_party")).cast("int")
    put = lambda new, old: F.when(hit, new).otherwise(F.col(old))
    return out.withColumns(
        {
            "cabinet_party_count": put(F.size(parties), "cabinet_party_count"),
            "cabinet_is_coalition": put(F.size(parties) > 1, "cabinet_is_coalition"),
            "cabinet_gov_seats": put(F.col("_set.seats"), "cabinet_gov_seats"),
            "party_in_government": put(governs, "party_in_government"),
            "party_prime_minister": put((F.col("speech_party") == F.col("_set.prime_minister_party")).cast("int"), "party_prime_minister"),
            "party_cabinet_seats": put(F.when(governs == 1, F.col("_set.seats")).otherwise(0.0), "party_cabinet_seats"),
            "party_constituents_in_government": put(governs, "party_constituents_in_government"),
            "cabinet_context_source": put(F.lit("parlgov_with_sourced_override"), "cabinet_context_source"),
            "cabinet_context_note": put(F.col("_set.note"), "cabinet_context_note"),
        }
    ).drop("_set")
