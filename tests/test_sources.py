import io
import json
import sqlite3
import zipfile
from xml.etree import ElementTree as ET

import pytest

from citeweave import engine
from citeweave.sources import office, settings, sqlite, traffic
from citeweave.streaming import documents

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def r(text):
    return f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def field(shown, what="ADDIN ZOTERO_ITEM x"):
    return f'<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>{what}</w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>{r(shown)}<w:r><w:fldChar w:fldCharType="end"/></w:r>'


def docx(*paragraphs, extra="", notes=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<?xml version='1.0'?><w:document {NS}><w:body>" + "".join(f"<w:p>{p}</w:p>" for p in paragraphs) + extra + "</w:body></w:document>")
        z.writestr("word/styles.xml", "<x/>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {NS}>{notes}</w:footnotes>")
    return out.getvalue()


def odt(*paragraphs):
    out = io.BytesIO()
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f"<office:document-content {ns}><office:body><office:text>" + "".join(f"<text:p>{p}</text:p>" for p in paragraphs) + "</office:text></office:body></office:document-content>")
    return out.getvalue()


def test_word_text():
    note = '<w:footnote w:type="separator"><w:p/></w:footnote><w:footnote><w:p><w:r><w:t>See (Lee, 2001)</w:t></w:r></w:p></w:footnote>'
    table = f"<w:tbl><w:tr><w:tc><w:p>{r('cell')}</w:p></w:tc></w:tr></w:tbl>"
    sdt = f"<w:sdt><w:sdtContent><w:p>{r('block')}</w:p></w:sdtContent></w:sdt>"
    data = docx(r("a ") + f"<w:ins><w:ins>{r('new')}</w:ins></w:ins><w:del>{r('old')}</w:del>", r("Coded ") + field("(Smith, 2020)") + r(" end"), r("p") + field("7", "PAGE"), extra=table + sdt, notes=note)
    assert list(office.opened("x.docx", data).texts()) == [("body", 0, "a new"), ("body", 1, "Coded (Smith, 2020) end"), ("body", 2, "p7"), ("body", 3, "block"), ("body", 4, "cell"), ("note", -2, "See (Lee, 2001)")]


def test_word_write():
    doc = office.opened("x.docx", docx(r("A (Smi") + r("th, 2020) and (Lee, 2001).")))
    assert doc.code(0, 20, 31, "(Lee, 2001)", '{"n":2}') and doc.code(0, 2, 15, "(Smith, 2020)", '{"n":1}')
    assert not doc.code(0, 2, 15, "(Smith, 2020)", "{}") and not doc.code(9, 0, 1, "x", "{}")
    saved = doc.save()
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(saved)).read("word/document.xml"))
    assert [i.text for i in root.iter(office.W + "instrText")] == [' ADDIN ZOTERO_ITEM CSL_CITATION {"n":1} ', ' ADDIN ZOTERO_ITEM CSL_CITATION {"n":2} ']
    assert "styles" in str(zipfile.ZipFile(io.BytesIO(saved)).namelist())
    assert list(office.opened("x.docx", saved).texts()) == [("body", 0, "A (Smith, 2020) and (Lee, 2001).")]


def test_open_text():
    note = "<text:note><text:note-body><text:p>n</text:p></text:note-body></text:note>"
    doc = office.opened("x.ODT", odt(f"A <text:span>(Smith, 2020)</text:span>{note} tail (Lee, 2001)"))
    assert next(doc.texts()) == ("body", 0, "A (Smith, 2020) tail (Lee, 2001)")
    assert doc.code(0, 21, 32, "(Lee, 2001)", "{}") and doc.code(0, 2, 15, "(Smith, 2020)", "{}") and not doc.code(0, 0, 20, "", "{}")
    assert next(office.opened("x.odt", doc.save()).texts())[2] == "A (Smith, 2020) tail (Lee, 2001)"


@pytest.fixture
def library(tmp_path):
    path = tmp_path / "library.sqlite"
    con = sqlite3.connect(path)
    con.executescript("""
      CREATE TABLE items (itemID INTEGER PRIMARY KEY, key TEXT, libraryID INT, itemTypeID INT, dateAdded TEXT);
      CREATE TABLE itemTypes (itemTypeID INTEGER PRIMARY KEY, typeName TEXT);
      CREATE TABLE deletedItems (itemID INTEGER PRIMARY KEY);
      CREATE TABLE fields (fieldID INTEGER PRIMARY KEY, fieldName TEXT);
      CREATE TABLE itemData (itemID INT, fieldID INT, valueID INT);
      CREATE TABLE itemDataValues (valueID INTEGER PRIMARY KEY, value TEXT);
      CREATE TABLE itemCreators (itemID INT, creatorID INT, creatorTypeID INT, orderIndex INT);
      CREATE TABLE creators (creatorID INTEGER PRIMARY KEY, firstName TEXT, lastName TEXT);
      CREATE TABLE creatorTypes (creatorTypeID INTEGER PRIMARY KEY, creatorType TEXT);
      CREATE TABLE collections (collectionID INTEGER PRIMARY KEY, collectionName TEXT, parentCollectionID INT, libraryID INT);
      CREATE TABLE deletedCollections (collectionID INTEGER PRIMARY KEY);
      CREATE TABLE collectionItems (collectionID INT, itemID INT);
      CREATE TABLE settings (setting TEXT, key TEXT, value TEXT);
      CREATE TABLE libraries (libraryID INTEGER PRIMARY KEY, type TEXT);
      INSERT INTO itemTypes VALUES (1, 'book'), (2, 'note'), (3, 'journalArticle');
      INSERT INTO items VALUES (1, 'AAA', 1, 1, '2024-01-02 00:00:00'), (2, 'BBB', 1, 2, '2024-01-02 00:00:00'), (3, 'CCC', 1, 3, '2024-01-01 00:00:00'), (4, 'DDD', 1, 1, '2024-01-03 00:00:00');
      INSERT INTO deletedItems VALUES (4);
      INSERT INTO fields VALUES (1, 'title'), (2, 'date'), (3, 'publisher');
      INSERT INTO itemDataValues VALUES (1, 'On things'), (2, '2020-05-01'), (3, 'Press'), (4, 'More "things"'), (5, '2001');
      INSERT INTO itemData VALUES (1, 1, 1), (1, 2, 2), (1, 3, 3), (3, 1, 4), (3, 2, 5);
      INSERT INTO creators VALUES (1, 'Ann', 'Smith'), (2, 'Bo', 'Lee'), (3, 'Ed', 'Itor');
      INSERT INTO creatorTypes VALUES (1, 'author'), (2, 'editor');
      INSERT INTO itemCreators VALUES (1, 1, 1, 0), (1, 3, 2, 1), (3, 2, 9, 0);
      INSERT INTO collections VALUES (1, 'Top', NULL, 1), (2, 'Sub', 1, 1), (3, 'Gone', NULL, 1), (4, 'Orphan', 3, 1);
      INSERT INTO deletedCollections VALUES (3);
      INSERT INTO collectionItems VALUES (2, 1), (4, 3);
      INSERT INTO settings VALUES ('account', 'userID', '77');
      INSERT INTO libraries VALUES (1, 'user');
    """)
    con.commit()
    con.close()
    return str(path)


def test_sqlite(spark, library):
    items, records = engine.load_library(spark, library)
    rows = items.orderBy("lib_ord").collect()
    assert [(x.item_key, x.title, x.year, x.authors, x.editors) for x in rows] == [("AAA", "On things", "2020", ["Smith"], ["Itor"]), ("CCC", 'More "things"', "2001", ["Lee"], [])]
    assert rows[0].uri == "http://zotero.org/users/77/items/AAA"
    got = {x.item_id: json.loads(x.record) for x in records.collect()}
    assert got[1] == {"id": 1, "type": "book", "title": "On things", "author": [{"family": "Smith"}], "editor": [{"family": "Itor"}], "issued": {"date-parts": [[2020]]}, "publisher": "Press"}
    assert [x.item_key for x in engine.load_library(spark, library, 1)[0].collect()] == ["AAA"]
    with pytest.raises(Exception, match="missing"):
        sqlite.table(spark, library + "missing", "items")


def test_one_state_of_the_library(spark, library):
    """Relations that are read after the file has changed are still those of the same moment."""
    import sqlite3

    r = sqlite.relations(spark, library)
    before = r["members"].count(), r["works"].count()
    con = sqlite3.connect(library)
    con.execute("DELETE FROM collectionItems")
    con.execute("DELETE FROM items")
    con.commit()
    con.close()
    assert (r["members"].count(), r["works"].count()) == before
    assert sqlite.relations(spark, library)["works"].count() == 0


def test_order_of_the_library(spark, monkeypatch):
    """Items of one second keep apart, however large their ids."""
    works = spark.createDataFrame([(i, f"K{i}", "book", d, 1) for i, d in [(5, "2020-01-01 00:00:00"), (100_005, "2020-01-01 00:00:00"), (10**12, "2021-01-01 00:00:00"), (7, None)]], "item_id long, item_key string, type_name string, date_added string, library_id int")
    none = lambda schema: spark.createDataFrame([], schema)
    tables = {
        "works": works, "fields": none("item_id long, field_name string, field_value string, ord long"), "people": none("item_id long, order_index int, last_name string, first_name string, creator_role string"),
        "deleted": none("item_id long"), "collections": none("coll_id long"), "members": none("coll_id long, item_id long"),
    }
    monkeypatch.setattr(sqlite, "relations", lambda *a: tables)
    monkeypatch.setattr(sqlite, "user_id", lambda *a: "1")
    rows = engine.load_library(spark, "x")[0].orderBy("lib_ord").collect()
    assert [r.item_id for r in rows] == [10**12, 5, 100_005, 7] and len({r.lib_ord for r in rows}) == 4


def test_usual_places(tmp_path):
    assert sqlite.default_file("library.sqlite", tmp_path) is None
    for folder in (".zotero", "Zotero"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "library.sqlite").touch()
        assert sqlite.default_file("library.sqlite", tmp_path) == tmp_path / folder / "library.sqlite"


def test_documents_of_one_name(spark, tmp_path):
    rows = [(f"file:/data/{d}/x.docx", d.encode()) for d in ("a", "b", "ab/c")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert office.save_files(df, str(tmp_path / "out")) == 3
    assert {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*.docx")} == {f"{d}/x.docx": d.encode() for d in ("a", "b", "ab/c")}
    assert office.save_files(df.limit(0), str(tmp_path / "none")) == 0


def test_collections_with_circles(spark):
    from citeweave.operators import library as lib

    c = spark.createDataFrame([(1, "a", 2, 1, False), (2, "b", 1, 1, False), (3, "c", 2, 1, False), (4, "d", 9, 1, False)], "coll_id long, coll_name string, parent_id long, library_id int, deleted boolean")
    assert {x.coll_id: x.path for x in lib.collection_paths(c).collect()} == {1: "b / a", 2: "a / b", 3: "a / b / c", 4: "d"}
    assert {x.coll_id for x in lib.descendants(c, 1).collect()} == {1, 2, 3}
    assert {x.coll_id for x in lib.descendants(c, 42).collect()} == {42}


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "one.docx").write_bytes(docx(r("Said (Smith, 2020) and (Nobody, 1990); Lee (2002) too."), r("Twice (Smith, 2020, p. 4; Lee 2001)")))
    (d / "two.odt").write_bytes(odt("As (Lee, 2001) has it."))
    (d / "bad.docx").write_bytes(b"no zip")
    return str(d)


def test_whole_way(spark, library, folder, tmp_path):
    a = engine.analyse(spark, folder + "/*.*", library)
    got = {(x.path.rsplit("/", 1)[1], x.display): (x.outcome, x.item_key) for x in a.results.collect()}
    assert got == {
        ("one.docx", "(Smith, 2020)"): ("matched", "AAA"), ("one.docx", "(Nobody, 1990)"): ("unmatched", None), ("one.docx", "(Lee, 2002)"): ("suggestion", "CCC"),
        ("one.docx", "(Lee, 2001)"): ("matched", "CCC"), ("two.odt", "(Lee, 2001)"): ("matched", "CCC"),
    }
    docs = engine.write(a).where("path not like '%bad%'")
    assert {x.path.rsplit("/", 1)[1]: x.n_written for x in docs.select("path", "n_written").collect()} == {"one.docx": 2, "two.odt": 1}
    assert office.save_files(docs, str(tmp_path / "out")) == 2
    saved = zipfile.ZipFile(tmp_path / "out" / "one.docx").read("word/document.xml").decode()
    payload = json.loads(ET.fromstring(saved).findall(f".//{office.W}instrText")[1].text.split("CSL_CITATION", 1)[1])
    assert [i["itemData"]["id"] for i in payload["citationItems"]] == [1, 3] and payload["citationItems"][0]["locator"] == "4"
    lines = [x.line for x in engine.report(a).orderBy("part", "ord").collect()]
    assert lines[1:3] == ["Total unmatched: 2", ""] and sorted(lines[3:]) == ["(Lee, 2002)  [para 1]  [suggestion: CCC (2001)]\n", "(Nobody, 1990)  [para 1]\n"]
    engine.save_report(engine.report(a), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first().value.startswith("Unmatched citations from: ")
    assert a.status()["status"] == "done" and a.status()["counts"]["total"] == 6
    assert [c.coll_name for c in engine.collections(spark, library).collect()] != []
    settings.save(tmp_path / "s.json", {"db_path": library, "more": 1})
    assert engine.state(tmp_path / "s.json") == {"docx_path": None, "db_path": library, "collection_id": None}
    assert a.counts().first().asDict() == {"matched": 4, "ambiguous": 0, "suggestions": 1, "total": 6, "unmatched": 1}


def test_stream(spark, folder, tmp_path):
    q = documents.citation_stream(spark, folder + "/*.odt", str(tmp_path / "cites"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert [x.display_text for x in spark.read.parquet(str(tmp_path / "cites")).collect()] == ["(Lee, 2001)"]


def test_settings(tmp_path):
    p = tmp_path / "a" / "s.json"
    assert settings.load(p) == {}
    assert settings.update(p, "x", 1) == {"x": 1} and settings.update(p, "y", "é") == settings.load(p) == {"x": 1, "y": "é"}
    p.write_text("[1]")
    assert settings.load(p) == {}
    p.write_text("{")
    assert settings.load(p) == {}


def test_traffic(spark, tmp_path):
    (tmp_path / "t.csv").write_text("date,views,unique_views,clones,unique_clones\n2026-01-01,1,1,0,0\n2026-01-02,2,1,0,0\n")
    log = traffic.read(spark, str(tmp_path / "t.csv"))
    days = spark.createDataFrame([("2026-01-02", 5, 2, 0, 0), ("2026-01-03", 1, 1, 0, 0)], "d string, views long, unique_views long, clones long, unique_clones long").selectExpr("cast(d as date) date", "views", "unique_views", "clones", "unique_clones")
    assert [(str(x.date), x.views) for x in traffic.upserted(log, days).collect()] == [("2026-01-01", 1), ("2026-01-02", 5), ("2026-01-03", 1)]
