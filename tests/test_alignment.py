import random

import pytest

from sextant import cli
from sextant.operators.topics import Params, topic_count
from sextant.plans import alignment
from sextant.sources import tei


def test_study_end_to_end(spark, tmp_path):
    r = random.Random(1)
    words = {"tax": "budget tax euro bank", "war": "army war border peace"}
    speeches, sentences = [], []
    for i in range(240):
        party, label = r.choice(["Á-B", "Cd", "X"]), r.choice(list(words))
        speeches.append(("speech", "regular", f" {party} ", f"20{10 + i % 6}-{1 + i % 12:02d}-{1 + i % 28:02d}", " ".join(r.choice(words[label].split()) for _ in range(20)), label))
    speeches += [("speech", "chair", "Cd", "2011-01-01", "x", "tax"), ("speech", "regular", "", "2011-01-01", "x", "tax"), ("speech", "regular", "Cd", "2011-02-30", "x", "tax")]
    extract = spark.createDataFrame(speeches, "content_kind string, speaker_type string, party string, date string, text string, topic_label string")
    catalogue = spark.createDataFrame([("L", 1, "Ab Union", "AB", 201001, "05/01/2010"), ("L", 1, "Ab Union", "AB", 201301, None), ("L", 2, "CD", None, 201206, "01/06/2012"), ("M", 9, "X", "X", 201001, None)], "countryname string, party int, partyname string, partyabbrev string, date int, edate string")
    for key in ("1_201001", "1_201301", "2_201206"):
        sentences += [(key, k, " ".join(r.choice((words["tax"] + " " + words["war"]).split()) for _ in range(8))) for k in range(12)]
    elections = spark.createDataFrame([("2010-01-10",), ("2014-01-10",)], "d string").selectExpr("to_date(d) as date")
    got = alignment.run(extract, catalogue, spark.createDataFrame(sentences, "doc_key string, quasi_sentence_id int, text string"), elections, "L", Params(topics_per_label=1, latent_topics=1, min_cf=2), iterations=5)
    mapped = {x.speech_party: (x.mapping_status, x.match_method, x.mpds_party_id) for x in got["mapping"].collect()}
    assert mapped == {"Á-B": ("mapped", "canonical_abbrev", 1), "Cd": ("mapped", "exact_name", 2), "X": ("unmapped", "", None)}
    bridge = got["bridge"].toPandas()
    assert set(bridge.doc_key) == {"1_201001", "1_201301", "2_201206"} and bridge.speech_rows.sum() == extract.filter("speaker_type = 'regular' and trim(party) in ('Á-B', 'Cd')").count() - 1
    early = bridge[(bridge.speech_party == "Cd") & (bridge.date.astype(str) < "2012-06-01")]
    assert set(early.selection_method) == {"fallback_to_earliest_manifesto"} and set(bridge[bridge.date.astype(str) >= "2013-01-01"].selection_method) == {"latest_manifesto_on_or_before_speech_date"}
    a = got["alignment"].toPandas()
    assert len(a) and a.js_distance.between(0, 1).all() and ((a.alignment_score + a.js_distance - 1).abs() < 1e-12).all()
    panel = got["panel"].toPandas()
    assert len(panel) == len(a) and panel.electoral_cycle_progress.dropna().between(0, 1).all()
    assert "R2" in got["fit"].report()


def test_stages_read_what_earlier_ones_wrote(spark, tmp_path, capsys):
    r = random.Random(2)
    words = {"tax": "budget tax euro bank", "war": "army war border peace"}
    rows = []
    for i in range(120):
        label = r.choice(list(words))
        rows.append(("speech", "regular", r.choice(["AB", "Cd"]), f"20{10 + i % 6}-{1 + i % 12:02d}-{1 + i % 28:02d}", " ".join(r.choice(words[label].split()) for _ in range(15)), label))
    spark.createDataFrame(rows, "content_kind string, speaker_type string, party string, date string, text string, topic_label string").write.parquet(f"{tmp_path}/L/speeches")
    spark.createDataFrame([(k, i, "budget war tax peace") for k in ("1_201001", "2_201206") for i in range(4)], "doc_key string, quasi_sentence_id int, text string").write.parquet(f"{tmp_path}/L/sentences")
    spark.createDataFrame([("2010-01-10",), ("2014-01-10",)], "d string").selectExpr("to_date(d) as date").write.parquet(f"{tmp_path}/L/elections")
    (tmp_path / "c.csv").write_text("countryname,party,partyname,partyabbrev,date,edate\nLand,1,Ab Union,AB,201001,05/01/2010\nLand,2,CD,,201206,01/06/2012\n")
    paths = ["--speeches", f"{tmp_path}/{{code}}/speeches", "--sentences", f"{tmp_path}/{{code}}/sentences", "--elections", f"{tmp_path}/{{code}}/elections", "--catalogue", f"{tmp_path}/c.csv", "--out", f"{tmp_path}/out/{{code}}"]
    few = ["--topics-per-label", "1", "--min-cf", "2", "--iterations", "3", "--inference-iterations", "5"]
    assert cli.main(["L=Land", "--skip-extract", *paths, *few]) == 0
    said = capsys.readouterr().out
    assert "==> L regression" in said and "extract" not in said and "R2" in said
    panel = spark.read.parquet(f"{tmp_path}/out/L/panel")
    assert panel.columns[:5] == ["speech_party", "month", "month_start", "analysis_date", "alignment_score"] and panel.count() == spark.read.parquet(f"{tmp_path}/out/L/alignment").count() > 0
    assert not any(c.startswith("topics") for c in spark.read.parquet(f"{tmp_path}/out/L/panel_model").columns)
    assert cli.main(["L=Land", "--skip-extract", "--skip-party-mapping", "--skip-manifesto-builder", "--skip-regression", *paths, *few]) == 0
    assert "party-mapping" not in capsys.readouterr().out


def test_corpora_are_found(spark, tmp_path):
    for name in ("all/P-LV/P-LV.TEI", "all/P-CZ/P-CZ.TEI", "one.TEI", "flat"):
        (tmp_path / name).mkdir(parents=True)
    for kind in ("listPerson", "listOrg"):
        (tmp_path / "flat" / f"P-{kind}.xml").write_text("<x/>")
    names = lambda path: [tei.corpus_name(r) for r in tei.corpus_roots(spark, f"{tmp_path}/{path}")]
    assert names("all") == [("P-CZ", "CZ"), ("P-LV", "LV")] and names("all/P-CZ") == [("P-CZ", "CZ")]
    assert names("one.TEI") == [("one", "")] and tei.corpus_roots(spark, f"{tmp_path}/flat") == [f"{tmp_path}/flat"]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        names("none")


def test_command_line(capsys):
    assert cli.countries(["cz,LV", "cz", "ee=Estonia"]) == {"CZ": "CZ", "LV": "LV", "EE": "Estonia"}
    assert cli.main(["CZ", "LV=Latvia", "--dry-run"]) == 0 and "Latvia" in capsys.readouterr().out

    def stage(code, name):
        if code == "B":
            raise ValueError("bad")
        return name

    assert cli.run_all({"A": "a", "B": "b", "C": "c"}, stage, True) == ({"A": "a", "C": "c"}, ["B"])
    assert cli.run_all({"A": "a", "B": "b", "C": "c"}, stage, False) == ({"A": "a"}, ["B"])


def test_topic_counts():
    assert topic_count(5, [18, 20]) == 5 and topic_count(None, [18]) == 18
    for bad in ((0, [18]), (None, [18, 20]), (None, [])):
        with pytest.raises(ValueError):
            topic_count(*bad)
