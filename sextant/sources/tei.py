"""Parliamentary transcripts in TEI: files to a table of speeches.

Only what needs a document tree is done in Python: one pass over each file gives a row for each utterance and note, with the
heading and notes before it. People, organisations and taxonomies are tables. All else is relational: segments are exploded,
speakers joined, parties looked up by the interval that holds the sitting's date, markers parsed by expressions.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_iso_date
from ..functions.text import clean_text, join_unique
from ..operators.joins import interval_lookup, sized_broadcast

# Fixed values of the format: its name spaces, markers and roles.
TEI, XML = "{http://www.tei-c.org/ns/1.0}", "{http://www.w3.org/XML/1998/namespace}"
ROLES = ("chair", "regular", "guest")
PROCEDURAL_NOTES = ("comment", "narrative", "date", "time")
PARTY_PREFIXES, GROUP_PREFIXES = ("politicalParty.", "pp."), ("parliamentaryGroup.", "fr.", "gr.")
GROUP_ROLES = ("parliamentaryGroup", "parliamentaryFaction")

EVENTS = (
    "path string, pos int, doc_id string, doc_lang string, doc_ana string, text_ana string, dates array<string>, term string, session string, sitting string, url string,"
    " kind string, div_type string, section_head string, pre_types array<string>, pre_texts array<string>, id string, who string, ana string, source string, note_type string, text string,"
    " segments array<struct<id:string,text:string>>, inline_types array<string>, kinesic_types array<string>"
)


def _squeezed(node: ET.Element | None) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _header(root: ET.Element, path: str) -> dict:
    """What holds for the whole file. dates: candidates in order of preference."""
    sittings = [d.get("when") for s in root.iter(TEI + "profileDesc") for g in s.iter(TEI + "setting") for d in g.iter(TEI + "date") if "#parla.sitting" in d.get("ana", "")]
    sources = list(root.iter(TEI + "sourceDesc"))
    cited = [d.get("when") for s in sources for b in s.iter(TEI + "bibl") for d in b.iter(TEI + "date")]
    other = [d.get("when") for s in sources for d in s.iter(TEI + "date")]
    named = re.search(r"(?:19|20)\d{2}-\d{2}-\d{2}", path.rsplit("/", 1)[-1])
    meetings = [(m.get("ana", ""), m.get("n") or _squeezed(m)) for t in root.iter(TEI + "titleStmt") for m in t.findall(TEI + "meeting")]
    pick = lambda *marks: next((v for ana, v in meetings if v and any(m in ana for m in marks)), "")
    text = next(root.iter(TEI + "text"), None)
    return {
        "doc_id": root.get(XML + "id") or re.sub(r"\.xml$", "", path.rsplit("/", 1)[-1]),
        "doc_lang": root.get(XML + "lang", ""),
        "doc_ana": " ".join(root.get("ana", "").split()),
        "text_ana": " ".join(text.get("ana", "").split()) if text is not None else "",
        "dates": [d for d in [*sittings, *cited, *other, named[0] if named else None] if d],
        "term": pick("#parla.term"),
        "session": pick("#parla.session", "#parla.meeting"),
        "sitting": pick("#parla.sitting"),
        "url": next((u for s in sources for i in s.iter(TEI + "idno") if i.get("subtype") == "parliament" and (u := _squeezed(i))), ""),
    }


def events_of(path: str, content: bytes) -> Iterator[dict]:
    """Utterances and notes of a file in their order."""
    root = ET.fromstring(content)
    common, pos = {"path": path} | _header(root, path), 0
    for div in root.iter(TEI + "div"):
        head, waiting = "", []
        for node in div:
            name = node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""
            words = _squeezed(node) if name in ("head", "note", "u") else ""
            if name == "head":
                head = words or head
            elif name == "note" and words or name == "u":
                pos += 1
                row = common | {"pos": pos, "kind": name, "div_type": div.get("type", ""), "section_head": head, "id": node.get(XML + "id"), "text": words}
                if name == "note":
                    note = (node.get("type", "untyped"), words)
                    waiting.append(note)
                    yield row | {"note_type": note[0]}
                else:
                    yield row | {
                        "who": node.get("who", ""),
                        "ana": " ".join(node.get("ana", "").split()),
                        "source": node.get("source", ""),
                        "pre_types": [t for t, _ in waiting],
                        "pre_texts": [t for _, t in waiting],
                        "segments": [{"id": s.get(XML + "id"), "text": _squeezed(s)} for s in node.findall(TEI + "seg")],
                        "inline_types": [n.get("type", "untyped") for n in node.iter(TEI + "note")],
                        "kinesic_types": [n.get("type", "unspecified") for n in node.iter(TEI + "kinesic")],
                    }
                    waiting = []


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in re.split(r",\s*(?=\w+ (?:string|int|array))", EVENTS)]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = list(events_of(path, content))
            if rows:
                yield pd.DataFrame(rows).reindex(columns=names).astype(object).where(lambda d: d.notna(), None)


def files(spark: SparkSession, root: str, pattern: str = "*.xml") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "content")


def corpus_roots(spark: SparkSession, path: str) -> list[str]:
    """Folders that hold a corpus each: the path itself if its lists of persons and organisations are there, else its *.TEI
    folders, else those one level below, else the path if it is named so. Works on any store that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def found(pattern: str) -> list[str]:
        at = jvm.org.apache.hadoop.fs.Path(pattern)
        return sorted(s.getPath().toString() for s in at.getFileSystem(conf).globStatus(at) or ())

    base = path.rstrip("/")
    if found(f"{base}/*-listPerson.xml") and found(f"{base}/*-listOrg.xml"):
        return [base]
    below = found(f"{base}/*.TEI") or found(f"{base}/*/*.TEI") or ([base] if base.endswith(".TEI") else [])
    if not below:
        raise FileNotFoundError(f"no corpus below {path}")
    return below


def corpus_name(root: str) -> tuple[str, str]:
    """(corpus id, country) by the folder's name."""
    name = root.rstrip("/").rpartition("/")[2].removesuffix(".TEI")
    country = re.search(r"-([A-Za-z]+)", name)
    return name, country[1] if country else ""


def speech_files(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Transcripts: XML files below a folder named by a year; the first max_files by path, if given."""
    found = files(spark, root).filter(F.col("path").rlike(r"/\d{4}/") & ~F.col("path").rlike("listPerson|listOrg|taxonomy"))
    return found.orderBy("path").limit(max_files) if max_files else found


def events(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    return speech_files(spark, root, max_files).mapInPandas(_parse, EVENTS)


def _rows(make, schema: str):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(make(ET.fromstring(content))), columns=names)

    return run


def _orgs(root: ET.Element):
    for org in root.iter(TEI + "org"):
        names = [(n.get("full", ""), n.get(XML + "lang", ""), _squeezed(n)) for n in org.findall(TEI + "orgName")]
        rank = lambda x: 0 if x[0] == "abb" else 1 if x[0] == "yes" and x[1] == "en" else 2 if x[0] == "yes" else 3
        best = min((n for n in names if n[2]), key=rank, default=("", "", ""))[2]
        yield org.get(XML + "id"), best or org.get(XML + "id"), org.get("role", "")


def organisations(spark: SparkSession, root: str) -> DataFrame:
    """(org, name, role): an abbreviation, else an English full name, else a full name, else any, else the id."""
    return files(spark, root, "*listOrg.xml").mapInPandas(_rows(_orgs, "org string, name string, role string"), "org string, name string, role string")


def _people(root: ET.Element):
    for person in root.iter(TEI + "person"):
        label = _squeezed(person.find(TEI + "persName")) or person.get(XML + "id")
        held = [(a.get("ref", ""), a.get("role", ""), a.get("from"), a.get("to")) for a in person.findall(TEI + "affiliation")] or [("", "", None, None)]
        for k, (ref, role, start, end) in enumerate(held):
            yield person.get(XML + "id"), label, ref.lstrip("#"), role, start, end, k


def affiliations(spark: SparkSession, root: str) -> DataFrame:
    """(person, name, org, role, start, end, place): one row for each affiliation; without any, one without org."""
    schema = "person string, name string, org string, role string, start string, end string, place int"
    rows = files(spark, root, "*listPerson.xml").mapInPandas(_rows(_people, schema), schema)
    return rows.withColumns({"start": parse_iso_date(F.col("start")), "end": parse_iso_date(F.col("end"))})


def _categories(root: ET.Element):
    for c in root.iter(TEI + "category"):
        found = [(0 if d.get(XML + "lang") == "en" else 1 if d.get(XML + "lang") else 2, _squeezed(d.find(TEI + "term")) or _squeezed(d)) for d in c.findall(TEI + "catDesc")]
        label = min((x for x in found if x[1]), key=lambda x: x[0], default=(0, ""))[1]
        if label:
            yield c.get(XML + "id"), label


def taxonomy(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(code, label); empty where there is no such file."""
    return files(spark, root, pattern).mapInPandas(_rows(_categories, "code string, label string"), "code string, label string")


def party_priority(org: Column, role: Column) -> Column:
    """0 for parties, 1 for groups in parliament, null for other organisations."""
    starts = lambda prefixes: F.lit(False) if not prefixes else F.coalesce(org.rlike("^(" + "|".join(re.escape(p) for p in prefixes) + ")"), F.lit(False))
    return F.when((role == "politicalParty") | starts(PARTY_PREFIXES), 0).when(role.isin(*GROUP_ROLES) | starts(GROUP_PREFIXES), 1)


def parse_markers(ana: Column, types: Column) -> dict[str, Column]:
    """speaker_type, topic_code and the remaining tokens of an utterance's markers. types: array of known speaker types."""
    all_tokens = F.filter(F.split(ana, r"\s+"), lambda t: t != "")
    kinds = F.filter(all_tokens, lambda t: t.startswith("#") & F.array_contains(types, F.substring(t, 2, 1_000_000)))
    topics = F.filter(all_tokens, lambda t: t.startswith("topic:"))
    kind, topic = F.try_element_at(kinds, F.lit(1)), F.try_element_at(topics, F.lit(1))
    rest = F.filter(all_tokens, lambda t: (kind.isNull() | (t != kind)) & (topic.isNull() | (t != topic)))
    return {
        "speaker_type": F.coalesce(F.substring(kind, 2, 1_000_000), F.lit("")),
        "topic_code": F.coalesce(F.substring(topic, 7, 1_000_000), F.lit("")),
        "ana_extra": join_unique(rest),
    }


def note_kind(div_type: Column, note_type: Column) -> Column:
    return F.when(note_type == "speaker", "speaker_marker").when((div_type == "commentSection") | note_type.isin(*PROCEDURAL_NOTES), "procedural_commentary").otherwise("note")


COLUMNS = (
    "corpus_id country date doc_id doc_lang doc_ana text_ana meeting_term meeting_session meeting_sitting source_doc_url div_type section_head pre_u_note_types pre_u_notes speaker speaker_id party"
    " speaker_type speaker_type_label topic_code topic_label ana_raw ana_extra unit_type content_kind speech_id unit_id note_type note_text inline_note_types inline_note_count kinesic_types"
    " kinesic_count text source source_file"
).split()


def speeches(spark: SparkSession, root: str, corpus_id: str, unit: str = "auto", include_notes: bool = False, max_files: int | None = None) -> DataFrame:
    """The table of speech units. unit: 'segment', 'speech', or 'auto' (segments where there are any)."""
    if unit not in ("segment", "speech", "auto"):
        raise ValueError(f"unit {unit!r}")
    found = events(spark, root, max_files)
    found = found.withColumn("date", F.coalesce(F.get(F.filter(F.transform("dates", parse_iso_date), lambda d: d.isNotNull()), F.lit(0))))
    said = found.filter("kind = 'u'").withColumn("speakers", F.filter(F.transform(F.split("who", r"\s+"), lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != ""))
    # A speaker's name and party on the day, for each distinct speaker and day.
    held = affiliations(spark, root)
    orgs = organisations(spark, root).dropDuplicates(["org"])
    days = said.select(F.explode("speakers").alias("person"), "date").distinct()
    known = held.join(sized_broadcast(orgs.select("org", F.col("name").alias("org_name"), F.col("role").alias("org_role"))), "org", "left")
    known = known.withColumn("party", F.coalesce("org_name", F.when(F.col("org") != "", F.col("org"))))
    looked = interval_lookup(days.withColumn("day", F.coalesce("date", F.lit("1900-01-01").cast("date"))), known, ["person"], "day", "start", "end", party_priority(F.col("org"), F.col("org_role")), ["place", "party"])
    names = held.groupBy("person").agg(F.min("name").alias("name"))
    one = looked.join(names, "person", "left").select("person", "date", F.coalesce("name", "person").alias("name"), "party")
    placed = said.select("path", "pos", "date", F.posexplode("speakers").alias("k", "person")).join(one.withColumnRenamed("date", "on"), ["person"]).filter(F.col("date").eqNullSafe(F.col("on")))
    listed = placed.groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("k", "name", F.coalesce("party", F.lit("")).alias("party")))).alias("s"))
    said = said.join(listed, ["path", "pos"], "left")
    types = taxonomy(spark, root, "*taxonomy-speaker_types.xml")
    topics = taxonomy(spark, root, "*taxonomy-topic.xml")
    codes = F.lit([*ROLES, *(r.code for r in types.select("code").distinct().collect())])  # a taxonomy is a short list
    for name, c in parse_markers(F.col("ana"), codes).items():
        said = said.withColumn(name, c)
    said = said.join(sized_broadcast(types.toDF("speaker_type", "speaker_type_label")), "speaker_type", "left").join(sized_broadcast(topics.toDF("topic_code", "topic_label")), "topic_code", "left")
    none = F.array().cast("array<struct<id:string,text:string>>")
    has = F.size("segments") > 0
    by_segment = F.lit(unit != "speech") & has
    whole = F.when(has, clean_text(F.array_join(F.filter(F.transform("segments", lambda s: s["text"]), lambda t: t != ""), " "))).otherwise(F.col("text"))
    one_unit = F.array(F.struct(F.col("id").alias("id"), whole.alias("text")))
    numbered = F.transform(F.coalesce("segments", none), lambda s, i: F.struct(F.coalesce(s["id"], F.concat(F.coalesce("id", F.lit("")), F.lit(".seg"), (i + 1).cast("string"))).alias("id"), s["text"].alias("text")))
    units = said.withColumn("by_segment", by_segment).withColumn("piece", F.explode(F.filter(F.when(by_segment, numbered).otherwise(one_unit), lambda u: u["text"] != "")))
    empty = F.lit("")
    common = lambda df: df.select(
        F.lit(corpus_id).alias("corpus_id"), F.regexp_extract(F.lit(corpus_id), "-([A-Za-z]+)", 1).alias("country"), F.coalesce(F.col("date").cast("string"), empty).alias("date"), "doc_id", "doc_lang", "doc_ana", "text_ana",
        F.col("term").alias("meeting_term"), F.col("session").alias("meeting_session"), F.col("sitting").alias("meeting_sitting"), F.col("url").alias("source_doc_url"), "div_type", "section_head",
        "pre_u_note_types", "pre_u_notes", "speaker", "speaker_id", "party", "speaker_type", "speaker_type_label", "topic_code", "topic_label", "ana_raw", "ana_extra", "unit_type", "content_kind", "speech_id", "unit_id",
        "note_type", "note_text", "inline_note_types", "inline_note_count", "kinesic_types", "kinesic_count", "text", "source", F.col("path").alias("source_file"), "pos",
    )
    out = common(
        units.withColumns(
            {
                "pre_u_note_types": join_unique(F.col("pre_types")),
                "pre_u_notes": join_unique(F.col("pre_texts"), " || "),
                "speaker": join_unique(F.transform("s", lambda x: x["name"])),
                "speaker_id": join_unique(F.col("speakers")),
                "party": join_unique(F.transform("s", lambda x: x["party"])),
                "ana_raw": F.col("ana"),
                "unit_type": F.when(F.col("by_segment"), "segment").otherwise("speech"),
                "content_kind": F.when(F.col("div_type") == "commentSection", "procedural_commentary").otherwise("speech"),
                "speech_id": F.col("id"),
                "unit_id": F.col("piece.id"),
                "note_type": empty,
                "note_text": empty,
                "inline_note_types": join_unique(F.col("inline_types")),
                "inline_note_count": F.size("inline_types").cast("string"),
                "kinesic_types": join_unique(F.col("kinesic_types")),
                "kinesic_count": F.size("kinesic_types").cast("string"),
                "text": F.col("piece.text"),
            }
        )
    )
    if include_notes:
        blank = {c: empty for c in COLUMNS if c not in found.columns and c not in ("corpus_id", "country", "date")}
        notes = found.filter("kind = 'note'").withColumns(blank).withColumns({"unit_type": F.lit("note"), "content_kind": note_kind(F.col("div_type"), F.col("note_type")), "unit_id": F.col("id"), "note_text": F.col("text"), "source": empty, "kinesic_types": empty})
        out = out.unionByName(common(notes))
    return out.na.fill("", COLUMNS)
