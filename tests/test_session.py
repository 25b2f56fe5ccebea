"""Session, parsing, exports, streaming over sample files."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from chandas.operators import nesting, search
from chandas.sources import catalog, console, sinks, tagged
from chandas.streaming import ingest

from .fixtures import VERSES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("Hymns")
    for name in ("Hymn 1.1", "Hymn 10.125"):
        head = "" if name == "Hymn 1.1" else "Mandala: 10\nSukta: 125\nRishis: a, b\nRishis: c\nDevatas: \n"
        (d / f"{name}.txt").write_text(head + "".join(f"[Verse {n}]\nDEV:{dev}\nIAST:{iast}\nENG: text Indra\n" for h, n, dev, iast in VERSES if h == name), encoding="utf-8")
    (d / "empty.TXT").write_text("")
    return d


@pytest.fixture(scope="module")
def session(spark, folder):
    s = catalog.Session(spark, str(folder))
    s.add("hymn 1.1.txt", "Hymn 10.125.txt", "Hymn 1.1.txt")
    return s


def test_catalog(session):
    assert session.available() == ["Hymn 1.1.txt", "Hymn 10.125.txt", "empty.TXT"]
    rows = session.summary().collect()
    assert [(r.hymn_index, r.export_base, r.verses) for r in rows] == [(1, "Hymn 1.1", 4), (2, "Hymn 10.125", 3), (3, "Hymn 1.1_2", 4)]
    h = session.hymns().filter("hymn_index = 2").first()
    assert (h.mandala, h.sukta, h.rishis, h.devatas) == (10, 125, ["a, b", "c"], [""])
    assert not session.remove("1,9") and catalog.resolve(["a", "b"], "2.txt") == "b"


def test_search_and_compare(session):
    assert session.search("find words containing .").startswith("Could not understand the search request.\nExamples:")
    assert session.search("find all verses containing INDRA").count() == 11 and session.search("find vowel span patterns (a") == search.BAD_PATTERN
    assert session.search("indra").count() == 0  # Roman text of words isn't searched in this mode
    assert session.search("find words beginning with अग्नि").count() >= 4
    c = {r.hymn_index: r for r in session.coverage("phoneme class velar").collect()}
    assert c[1].matched_verses == 4 and c[1].coverage == 1.0
    r = session.compare_verses("2:1, 2:2").first()
    assert round(r.phoneme_cosine_similarity, 6) == 0.935288 and round(r.meter_confidence, 6) == 0.757576
    assert isinstance(session.compare_verses("2:1, 9:9"), str)
    assert session.compare_hymns("1,3").first().phoneme_cosine_similarity == pytest.approx(1)


def test_describe(session):
    d = session.describe()
    first = d["verses"].filter("hymn_index = 2 and verse_ord = 1").first()
    assert first.pada_counts.count("-") == 3 and first.meter == "Tristubh-Jagati Mixed"
    assert d["words"].filter("hymn_index = 1 and verse_ord = 0").count() == 7
    total = {r.feat_key: r.feat_value for r in d["hymn_frequency"].filter("hymn_index = 2 and feat_type = 'Swara'").collect()}
    assert set(total) == {"udatta"}
    letters = d["letters"].filter("hymn_index = 1 and verse_ord = 0 and word_ord = 0").orderBy("letter_ord").collect()
    assert [(r.value, r.phoneme_class, r.vowel_length) for r in letters[:3]] == [("अ", "Vowel", "Short"), ("ग", "Velar", "None"), ("्", "Other", "None")]
    pairs = d["syllable_pairs"].filter("hymn_index = 1 and verse_ord = 0 and word_ord = 0").orderBy("syllable_ord").collect()
    assert [(p.dev, p.iast) for p in pairs] == [("अगनमळ", "a")]


def test_export(session, tmp_path):
    names = session.export(2, str(tmp_path))
    assert len(names) == 5
    sandhi = list(csv.reader((tmp_path / "Hymn 10.125_Sandhi.csv").open(encoding="utf-8-sig")))
    assert len(sandhi[0]) == 21 and sandhi[0][:5] == ["Mandala", "Sukta", "Verse", "Meter", "Surface_Word_Index"] and sandhi[0][6] == "Surface_IAST"
    full = list(csv.reader((tmp_path / "Hymn 10.125.csv").open(encoding="utf-8-sig")))
    assert len(full[0]) == 31 and full[0][-1] == "Letter_IAST_VowelLength" and all(len(r) == 31 for r in full)
    sim = list(csv.reader((tmp_path / "Hymn 10.125_Similarity.csv").open(encoding="utf-8-sig")))
    assert len(sim) == 4 and len(sim[0]) == 19 and sim[1][4:9] == ["1163.000000", "37.907783", "32.802439", "0.935288", "0.950089"]
    doc = json.loads((tmp_path / "Hymn 10.125.json").read_text(encoding="utf-8"))
    assert [v["verseNumber"] for v in doc["verses"]] == [1, 2, 3] and doc["verses"][0]["devWords"][0]["text"] == "अहं"


def test_repeated_lines_add_words(spark, tmp_path):
    (tmp_path / "two.txt").write_text("[Verse 1]\nDEV: क ख\nDEV: ग\nIAST: ka kha\nIAST: ga\n", encoding="utf-8")
    s = catalog.Session(spark, str(tmp_path))
    s.add("two.txt")
    d = s.describe()
    assert [r.text for r in d["words"].orderBy("word_ord").collect()] == ["क", "ख", "ग"] and d["verses"].first().dev == " ग"
    total = {r.feat_key: r.feat_value for r in d["hymn_frequency"].filter("feat_type = 'Letter'").collect()}
    assert total == {"क": 1, "ख": 1, "ग": 1} and s.search("find words containing ख").count() == 1
    doc = s.tables()["json"].first().document
    assert [w.text for w in doc.devWords] == ["क", "ख", "ग"] and doc.sandhi == [] and doc.analysis.letterFrequency == total


def test_documents_without_words_and_reading_back(spark):
    v = spark.createDataFrame([(1, 0, 1, None, " ", None, None), (1, 1, 2, None, "क ख", "ka kha", "e")], "hymn_index int, verse_ord int, verse_number int, meter string, dev string, iast string, eng string")
    j = nesting.verse_documents(v).select("verse_ord", F.to_json("document").alias("json"))
    rows = {r.verse_ord: r.json for r in j.collect()}
    empty = json.loads(rows[0])
    assert empty["devWords"] == [] and empty["sandhi"] == [] and empty["iastWords"] == [] and empty["analysis"] == {"letterFrequency": {}, "swaraFrequency": {}, "phonemeClassFrequency": {}, "meterPattern": []}
    back = {r.verse_ord: r for r in sinks.read_verse_json(j.unionByName(spark.createDataFrame([(9, "{")], j.schema))).collect()}
    w = back[1].devWords[0]
    assert (w.text, w.alignedIAST, w.letters[0].value, w.letters[0].phonemeClass) == ("क", "ka", "क", "Velar") and w.devSyllables[0].nucleus.value == "क" and w.alignment[0].iast.nucleus.value == "a"
    assert back[1].iastWords[1].text == "kha" and back[0].devWords == [] and back[9].devWords is None


def typed(lines):
    said, queue = [], list(lines)
    return said, lambda prompt: queue.pop(0) if queue else None, said.append


def test_console(spark, folder, tmp_path, monkeypatch):
    exported = []
    monkeypatch.setattr(catalog.Session, "export", lambda self, i, out: exported.append((i, out)))
    monkeypatch.setattr(catalog.Session, "compare_hymns", lambda self, refs: f"hymns {refs}")
    lines = ["1", "nothing.txt", "", "1", "9", "1", "4", "back", "4", "अग्नि", "1", "6", "(a", "2", "1", "help", "1:1", "2", "2", "1,2", "2", "3", "7", "3", "4", "2", "5", "1,7", "5", "2", "6", "7"]
    said, ask, say = typed(lines)
    s = catalog.Session(spark, str(folder))
    assert console.Console(s, ask, say).run("out") == 0
    text = "\n".join(said)
    assert said[0] == "Available hymn files in /Hymns:\n  [1] Hymn 1.1.txt\n  [2] Hymn 10.125.txt\n  [3] empty.TXT"
    assert 'Search results for word begins with "अग्नि"\nSummary by hymn:\n  [1] Hymn 1.1 matches=' in text and "Invalid selection." in said and said[-1] == "Session terminated."
    assert "Detailed matches:\n  [1] Hymn 1.1 Verse 1 DEV=" in text and search.BAD_PATTERN in said and "Select at least two verses." in said and "hymns 1,2" in said
    assert 'Comparison of query across loaded hymns: phoneme class "Palatal"' in text and "Matched verse references:" in text and "Invalid hymn selection." in said
    assert [n for _, n in s.loaded] == ["Hymn 1.1"] and exported == [(1, "out"), (2, "out")] and search.NOT_UNDERSTOOD in text


def test_console_ends(spark, folder, monkeypatch):
    monkeypatch.setattr(catalog.Session, "export", lambda self, i, out: None)
    for lines, code in ((["0"], 1), (["x"], 1), ([], 0)):
        said, ask, say = typed(lines)
        assert console.Console(catalog.Session(spark, str(folder)), ask, say).run() == code
    assert catalog.Session(spark, str(folder / "none")).available() == [] and catalog.Session(spark, str(folder)).summary().count() == 0


def test_parse_edges(spark):
    body = "DEV: a\n[Verse 0]\nIAST: b\n[Verse 2]\nDEV: c\nDEV: d\n[Verse 3]\nENG: x Rishis: y\n"
    p = tagged.lines(spark.createDataFrame([("k", body), ("n", None), ("e", "")], "k string, text string"), "k")
    v = tagged.verses(p, "k").orderBy("verse_ord").collect()
    assert [(r.verse_number, r.dev, r.iast, r.eng, r.dev_all) for r in v] == [(2, " d", " b", "", " a  c  d"), (3, "", "", "", "")]
    assert tagged.hymns(p, "k").first().rishis == ["y"]


def test_partitioned_write(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, i, [str(i)]) for i in range(100)], "hymn_index int, n int, a array<string>")
    sinks.write_partitioned(df, str(tmp_path / "t"), "hymn_index")
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted((r.hymn_index, r.n, r.a) for r in got.collect()) == sorted((r.hymn_index, r.n, r.a) for r in df.collect()) and (tmp_path / "t" / "hymn_index=1").is_dir()


def test_class_counts_of_a_stream(spark, tmp_path):
    rows = [("क ख", "2024-01-01 01:00:00"), ("क", "2024-01-01 02:00:00"), (None, "2024-01-01 03:00:00"), ("च", "2024-01-05 01:00:00"), ("य", "2024-01-09 01:00:00")]
    spark.createDataFrame(rows, "dev string, at string").selectExpr("dev", "cast(at as timestamp) at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("dev string, at timestamp").parquet(str(tmp_path / "in"))
    q = ingest.class_counts(stream, "at").writeStream.format("memory").queryName("class_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.window.start)[:10], r.phoneme_class): r.n for r in spark.table("class_counts").collect()}
    assert got == {("2024-01-01", "Velar"): 3, ("2024-01-05", "Palatal"): 1, ("2024-01-09", "Semivowel"): 1}


def test_stream(spark, folder, tmp_path):
    q = ingest.start(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).filter(F.col("verse_number") > 0).count() == 7
