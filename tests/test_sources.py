import datetime as dt
import sqlite3

import pytest

from sextant.sources import files, rest, sqlite, tei

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
ORGS = f"""<listOrg {NS}><org xml:id="politicalParty.A" role="politicalParty"><orgName full="yes" xml:lang="en">Alpha Party</orgName><orgName full="abb">AP</orgName></org>
<org xml:id="gr.B" role="parliamentaryGroup"><orgName full="yes">Beta Group</orgName></org><org xml:id="min" role="ministry"><orgName>Ministry</orgName></org></listOrg>"""
PEOPLE = f"""<listPerson {NS}><person xml:id="P1"><persName><surname>Novak</surname> <forename>Jan</forename></persName>
<affiliation ref="#politicalParty.A" from="2010-01-01" to="2015-12-31"/><affiliation ref="#gr.B" from="2016-01-01"/><affiliation ref="#min" from="2019-01-01"/></person>
<person xml:id="P2"><persName>Eva</persName><affiliation ref="#politicalParty.C"/></person></listPerson>"""
TYPES = f"""<taxonomy {NS}><category xml:id="regular"><catDesc xml:lang="cs">řádný</catDesc><catDesc xml:lang="en"><term>Regular</term>: a member</catDesc></category></taxonomy>"""
TOPICS = f"""<taxonomy {NS}><category xml:id="tax"><catDesc xml:lang="en"><term>Taxation</term></catDesc></category></taxonomy>"""
SPEECH = f"""<TEI {NS} xml:id="doc1" xml:lang="cs" ana="#parla.sitting  #reference"><teiHeader><fileDesc><titleStmt><meeting ana="#parla.term #x" n="7">t</meeting><meeting ana="#parla.sitting">Day 3</meeting></titleStmt>
<sourceDesc><bibl><idno subtype="parliament">http://p/1</idno><date when="2014-01-01"/></bibl></sourceDesc></fileDesc><profileDesc><settingDesc><setting><date ana="#parla.sitting" when="2014-03-05T09:00:00Z"/></setting></settingDesc></profileDesc></teiHeader>
<text ana="#reference"><body><div type="debateSection"><head>Budget  debate</head><note type="speaker">Chair:</note><note type="time">10:00</note><note type="time">10:00</note>
<u who="#P1 #P2" ana="#regular topic:tax #other" xml:id="u1" source="s1"><seg xml:id="u1.1">First <note type="aside">x</note> part</seg><seg> </seg><seg>Third <kinesic type="applause"/></seg></u>
<u who="#P9" ana="#chair" xml:id="u2">Plain   words</u></div><div type="commentSection"><u who="" xml:id="u3">Comment</u><note type="vote">yes</note></div></body></text></TEI>"""


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("tei") / "Minutes-CZ.TEI"
    (root / "2014").mkdir(parents=True)
    (root / "2016").mkdir()
    for name, content in (("CZ-listOrg.xml", ORGS), ("CZ-listPerson.xml", PEOPLE), ("CZ-taxonomy-speaker_types.xml", TYPES), ("CZ-taxonomy-topic.xml", TOPICS), ("2014/a_2014-03-05.xml", SPEECH)):
        (root / name).write_text(content)
    later = SPEECH.replace('xml:id="doc1"', 'xml:id="doc2"').replace('when="2014-03-05T09:00:00Z"', 'when="bad"').replace('when="2014-01-01"', 'when="2016-02-30"')
    (root / "2016/b_2016-05-06.xml").write_text(later)
    return str(root)


def test_speeches(spark, corpus):
    rows = tei.speeches(spark, corpus, "Minutes-CZ").orderBy("doc_id", "pos").collect()
    assert set(tei.COLUMNS) | {"pos"} == set(rows[0].asDict())
    one = [r for r in rows if r.doc_id == "doc1"]
    assert [(r.unit_type, r.unit_id, r.text) for r in one] == [("segment", "u1.1", "First x part"), ("segment", "u1.seg3", "Third"), ("speech", "u2", "Plain words"), ("speech", "u3", "Comment")]
    a = one[0]
    assert (a.country, a.date, a.meeting_term, a.meeting_sitting, a.source_doc_url, a.section_head) == ("CZ", "2014-03-05", "7", "Day 3", "http://p/1", "Budget debate")
    assert (a.speaker, a.speaker_id, a.party) == ("Novak Jan | Eva", "P1 | P2", "AP | politicalParty.C")
    assert (a.speaker_type, a.speaker_type_label, a.topic_code, a.topic_label, a.ana_extra) == ("regular", "Regular", "tax", "Taxation", "#other")
    assert (a.pre_u_note_types, a.pre_u_notes, a.inline_note_count, a.inline_note_types, a.kinesic_types) == ("speaker | time", "Chair: || 10:00", "1", "aside", "applause")
    assert (one[2].speaker, one[2].party, one[2].speaker_type, one[2].pre_u_notes) == ("P9", "", "chair", "")
    assert [r.content_kind for r in one] == ["speech"] * 3 + ["procedural_commentary"]
    two = [r for r in rows if r.doc_id == "doc2"]
    assert two[0].date == "2016-05-06" and two[0].party == "Beta Group | politicalParty.C"


def test_units_and_notes(spark, corpus):
    whole = tei.speeches(spark, corpus, "Minutes-CZ", unit="speech").filter("doc_id = 'doc1'").orderBy("pos").collect()
    assert [r.text for r in whole] == ["First x part Third", "Plain words", "Comment"]
    notes = tei.speeches(spark, corpus, "Minutes-CZ", include_notes=True).filter("unit_type = 'note' and doc_id = 'doc1'").orderBy("pos").collect()
    assert [(r.note_type, r.content_kind, r.text) for r in notes] == [("speaker", "speaker_marker", "Chair:"), ("time", "procedural_commentary", "10:00"), ("time", "procedural_commentary", "10:00"), ("vote", "procedural_commentary", "yes")]
    assert tei.speech_files(spark, corpus, 1).count() == 1
    with pytest.raises(ValueError):
        tei.speeches(spark, corpus, "x", unit="word")


def test_lists(spark, corpus):
    assert {r.org: r.name for r in tei.organisations(spark, corpus).collect()} == {"politicalParty.A": "AP", "gr.B": "Beta Group", "min": "Ministry"}
    assert tei.taxonomy(spark, corpus, "*none.xml").count() == 0
    held = tei.affiliations(spark, corpus).filter("person = 'P1'").orderBy("place").collect()
    assert [(r.org, r.start, r.end) for r in held][1] == ("gr.B", dt.date(2016, 1, 1), None)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "e.db")
    db = sqlite3.connect(path)
    db.executescript("create table election (id int, date text, seats real); insert into election values (1, '2010-01-01', 100.5), (2, null, null), (3, '2014-01-01', 7)")
    db.commit()
    df = sqlite.load_sql(spark, path, "select * from election where id <> ? order by id", [2])
    assert df.dtypes == [("id", "bigint"), ("date", "string"), ("seats", "double")]
    assert [tuple(r) for r in df.collect()] == [(1, "2010-01-01", 100.5), (3, "2014-01-01", 7.0)]


def served(endpoint, parameters):
    key = parameters["keys[]"][0]
    if key == "down":
        raise OSError("no route")
    if endpoint == "metadata":
        return {"items": [] if key == "gone" else [{"manifesto_id": f"m{key}", "language": "cs", "title": "T"}]}
    return {"items": [{"items": [] if key == "mempty" else [{"text": "a", "cmp_code": 101, "eu_code": None}, {"text": "b", "cmp_code": "H", "eu_code": "NA"}]}]}


def test_service_rows_carry_their_errors(spark):
    keys = spark.createDataFrame([(k,) for k in ("1", "gone", "down", "empty", "1")], "doc_key string")
    docs = rest.fetch_documents(keys, rest.Client(served, "v1")).cache()
    got = {r.doc_key: r for r in docs.collect()}
    assert {k: r.fetch_status for k, r in got.items()} == {"1": "ok", "gone": "error", "down": "error", "empty": "error"}
    assert "no route" in got["down"].fetch_error
    assert [(r.quasi_sentence_id, r.text, r.cmp_code, r.eu_code) for r in rest.sentences(docs).orderBy("quasi_sentence_id").collect()] == [(0, "a", "101", None), (1, "b", "H", "NA")]
    assert rest.status(docs).first().run_status == "partial"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nyou', None)], "a int, b string, c string")
    files.write_csv(df, str(tmp_path / "x"))
    back = files.read_csv(spark, str(tmp_path / "x"), ["b", "c"])
    assert tuple(back.first()) == ('say "hi",\nyou', None)
    assert files.read_csv(spark, str(tmp_path / "x"), keep_empty=True).first().c == ""
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, str(tmp_path / "x"), ["z"])
    (tmp_path / "w.txt").write_text("a\n\n b \n")
    assert files.stop_words(spark, str(tmp_path / "w.txt")) == ["a", "b"] and files.stop_words(spark, str(tmp_path / "none.txt")) == []
    u = files.union_tables({"A": df.drop("c"), "B": df.drop("b")})
    assert {(r.country_code, r.b is None) for r in u.collect()} == {("A", False), ("B", True)}
    assert files.suffixed("/x/m.csv", "CZ", lambda p: p == "/x/m_CZ.csv") == "/x/m_CZ.csv" and files.suffixed("/x/m.csv", "LV", lambda p: False) == "/x/m.csv"
    assert files.data_dir({"DATA_DIR": "D:\\parl\\x"}) == "/mnt/d/parl/x" and files.data_dir({}) == "data"


def test_streams_match_batches(spark, tmp_path):
    from sextant.streaming.volumes import daily_volumes, sessions

    rows = [(dt.datetime(2024, 1, d, h), k) for d in (1, 2, 3) for h in (1, 5) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    stream = daily_volumes(spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in")), "ts", "k")
    q = stream.writeStream.format("memory").queryName("volumes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r.start), r.k): r.n for r in spark.table("volumes").collect()}
    assert got == {(str(r.start), r.k): r.n for r in daily_volumes(df, "ts", "k").collect()} and set(got.values()) == {2}
    assert {r.n for r in sessions(df, "ts", "k", "5 hours").collect()} == {2}
    assert len(got) == 6


def test_sqlite_types_from_all_rows(spark, tmp_path):
    path = str(tmp_path / "late.db")
    db = sqlite3.connect(path)
    db.execute("create table x (a, b, c)")
    db.executemany("insert into x values (?, ?, ?)", [(i, i, None) for i in range(1200)] + [(2.5, "late", 7)])
    db.commit()
    df = sqlite.load_sql(spark, path, "select * from x order by rowid")
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "bigint")]
    assert tuple(df.collect()[-1]) == (2.5, "late", 7)
