"""Text and label expressions. All but canonical_label stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def clean_text(x: Column) -> Column:
    """White space runs to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def normalized(x: Column) -> Column:
    """Trimmed upper case; null to empty."""
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def canonical_ascii(x: Column) -> Column:
    """Upper-case letters and digits only, of labels without accents."""
    return F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", ""))


def canonical_key(label: str | None) -> str:
    """Compatibility decomposition without combining marks, upper case, letters and digits only."""
    apart = unicodedata.normalize("NFKD", label or "")
    return "".join(c for c in apart if not unicodedata.combining(c)).upper().translate(_NOT_ALNUM)


class _Dropping(dict):
    def __missing__(self, code: int):
        c = chr(code)
        self[code] = code if c.isalnum() else None
        return self[code]


_NOT_ALNUM = _Dropping()


def canonical_label(x: Column) -> Column:
    """canonical_key of any label, batch-wise; meant for columns of distinct labels, as cascade_lookup calls it."""

    @F.pandas_udf(StringType())
    def canonical(labels):  # type: ignore[no-untyped-def]
        return labels.map(canonical_key)

    return canonical(x)


def tokens(x: Column) -> Column:
    """Lower-cased maximal runs of letters, numbers and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def terms(x: Column) -> Column:
    """Tokens of two characters or more, as a bag-of-words vectorizer takes them."""
    return F.filter(tokens(x), lambda t: F.length(t) >= 2)


def word_count(x: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def join_unique(items: Column, sep: str = " | ") -> Column:
    """Distinct non-empty items in their order, joined."""
    return F.array_join(F.array_distinct(F.filter(items, lambda v: v.isNotNull() & (v != ""))), sep)


def safe_name(x: Column) -> Column:
    """A name fit for files: other characters to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", "")


def ordered_unique_codes(x: Column) -> Column:
    """Upper-cased distinct codes of a list that commas or white space separate, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(x, r"[,\s]+"), lambda c: F.upper(F.trim(c))), lambda c: c != ""))


def display_label(label: Column, index: Column) -> Column:
    return F.concat_ws(" ", label, index.cast("string"))


# Beginnings and ends that tell what a label names, by country, and what is said of labels without a party.
LABEL_PREFIXES = {"UA": (("ф", "faction"), ("г", "group"), ("б", "bloc"))}
LABEL_SUFFIXES = {"HU": (("-frakció", "faction"),)}
UNMAPPED_NOTES = {
    "group": "Parliamentary group label with no direct MPDS party match.",
    "faction": "Faction label with no confident direct MPDS party match.",
    "bloc": "Bloc label with no confident direct MPDS party match.",
}
OTHER_NOTE = "Parliamentary label present in speech data but not treated as a manifesto party."
PARTY_NOTE = "Party label present in %s parliamentary speeches but not mapped to an MPDS %s party."
BROAD_TOPICS = {
    "Agriculture": "Environment_Land_Energy",
    "Civil Rights": "Institutions_Rights_Law",
    "Culture": "Culture_Identity",
    "Defense": "Foreign_Security",
    "Domestic Commerce": "Economics",
    "Education": "Welfare_Human_Development",
    "Energy": "Environment_Land_Energy",
    "Environment": "Environment_Land_Energy",
    "Foreign Trade": "Economics",
    "Government Operations": "Institutions_Rights_Law",
    "Health": "Welfare_Human_Development",
    "Housing": "Welfare_Human_Development",
    "Immigration": "Foreign_Security",
    "International Affairs": "Foreign_Security",
    "Labor": "Economics",
    "Law and Crime": "Institutions_Rights_Law",
    "Macroeconomics": "Economics",
    "Public Lands": "Environment_Land_Energy",
    "Social Welfare": "Welfare_Human_Development",
    "Technology": "Infrastructure_Technology",
    "Transportation": "Infrastructure_Technology",
    "Other": "Residual",
    "Mix": "Residual",
}


def mapped(x: Column, table: Mapping[str, str]) -> Column:
    """The value of a static table; null where it has none."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), x)


def broad_topic(x: Column) -> Column:
    return mapped(x, BROAD_TOPICS)


def label_type(label: Column, country: str, known: Mapping[str, tuple[str, str]] = {}) -> Column:
    """What a label names: by the labels known (label -> type, note), by the country's beginnings and ends, else a party."""
    found = mapped(label, {k: kind for k, (kind, _) in known.items()})
    rules = [F.when(F.lower(label).startswith(p), F.lit(kind)) for p, kind in LABEL_PREFIXES.get(country, ())]
    rules += [F.when(label.endswith(e), F.lit(kind)) for e, kind in LABEL_SUFFIXES.get(country, ())]
    return F.coalesce(found, *rules, F.lit("party"))


def unmapped_note(label: Column, kind: Column, country: str, country_name: str, known: Mapping[str, tuple[str, str]] = {}) -> Column:
    """What is said of a label without a party, by its type."""
    by_type = F.coalesce(mapped(kind, UNMAPPED_NOTES), F.when(kind != "party", OTHER_NOTE), F.lit(PARTY_NOTE % (country, country_name)))
    return F.coalesce(mapped(label, {k: note for k, (_, note) in known.items()}), by_type)
