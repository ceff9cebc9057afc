"""Text documents (.docx, .odt) as paragraphs, and citations written back into them as fields.

One model serves reading and writing, so offsets always agree: a document is opened, tracked changes are accepted, coded
citations become their visible text again, and a list of paragraphs in reading order results. Each document is one row
of Spark's binaryFile source; the XML is read with the standard library in Arrow batches, a document at a time.
"""

from __future__ import annotations

import copy
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: names of the formats ---------------------------------------------------------------------------------
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
PRESERVE = "{http://www.w3.org/XML/1998/namespace}space"
#: What marks the instruction of a field as a coded citation or bibliography, and the kind that is written.
FIELD_MARKS = ("ZOTERO_ITEM", "EN.CITE", "EN.REFLIST")
FIELD_KIND = "ZOTERO_ITEM"
FIELD_HEAD = "ADDIN ZOTERO_ITEM CSL_CITATION"
MARK_HEAD = "ZOTERO_ITEM CSL_CITATION"
NOTE_BODIES = (TEXT + "footnote-body", TEXT + "endnote-body")
# ----------------------------------------------------------------------------------------------------------------------

SCHEMA = "path string, zone string, para_idx int, para_text string"


def _parse(data: bytes) -> ET.Element:
    """The tree of an XML part; its prefixes are kept for writing."""
    for _, (prefix, uri) in ET.iterparse(io.BytesIO(data), ("start-ns",)):
        if prefix and not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    return ET.fromstring(data)


def _parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {child: parent for parent in root.iter() for child in parent}


class Word:
    """A .docx file."""

    part = "word/document.xml"

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.root = _parse(self.zip.read(self.part))
        self._accept_changes()
        for p in self.root.iter(W + "p"):
            while self._uncode_one(p):
                pass
        self.paragraphs = list(self._in_order())

    def _accept_changes(self) -> None:
        for tag in ("rPrChange", "pPrChange", "del"):
            parents = _parents(self.root)
            for e in list(self.root.iter(W + tag)):
                if e in parents:
                    parents[e].remove(e)
        while (ins := next(self.root.iter(W + "ins"), None)) is not None:
            parent = _parents(self.root)[ins]
            at = list(parent).index(ins)
            parent[at : at + 1] = list(ins)

    @staticmethod
    def _uncode_one(p: ET.Element) -> bool:
        """Puts the visible runs of the first coded citation among the paragraph's own runs in its place."""
        begin = shown = None
        coded = False
        for k, run in enumerate(list(p)):
            if run.tag != W + "r":
                continue
            mark = run.find(W + "fldChar")
            if mark is None:
                text = run.findtext(W + "instrText") or ""
                coded = coded or begin is not None and any(m in text for m in FIELD_MARKS)
                continue
            kind = mark.get(W + "fldCharType")
            if kind == "begin":
                begin, shown, coded = k, None, False
            elif kind == "separate" and begin is not None:
                shown = k
            elif kind == "end" and begin is not None:
                if coded and shown is not None:
                    p[begin : k + 1] = list(p)[shown + 1 : k]
                    return True
                begin = shown = None
        return False

    def _in_order(self) -> Iterator[ET.Element]:
        body = self.root.find(W + "body")
        seen: set[int] = set()
        groups = (body.findall(W + "p"), body.findall(f"{W}sdt/{W}sdtContent/{W}p"), body.findall(f"{W}tbl/{W}tr/{W}tc/{W}p"))
        for p in (p for g in groups for p in g):
            if id(p) not in seen:
                seen.add(id(p))
                yield p

    def runs(self, p: ET.Element) -> list[tuple[ET.Element, int, int]]:
        """(run, start, end) of the runs that can be cut; text shown by a coded citation takes part in offsets only where it is text."""
        out, at, state = [], 0, [False, False]  # within a coded field; past its separator
        for e in p.iter():
            if e.tag == W + "fldChar":
                kind = e.get(W + "fldCharType")
                state = [state[0], state[0]] if kind == "separate" else [False, False]
            elif e.tag == W + "instrText":
                state[0] = state[0] or FIELD_KIND in (e.text or "")
            elif e.tag == W + "r":
                text = self.run_text(e)
                if not state[1]:
                    out.append((e, at, at + len(text)))
                at += len(text)
        return out

    @staticmethod
    def run_text(run: ET.Element) -> str:
        return "".join(t.text or "" for t in run.findall(W + "t"))

    def texts(self) -> Iterator[tuple[str, int, str]]:
        """(zone, index, text) of all paragraphs; those of notes count down from -1 by note, separators included."""
        for k, p in enumerate(self.paragraphs):
            yield "body", k, self._visible(p)
        for name, tag in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
            if name not in self.zip.namelist():
                continue
            for k, note in enumerate(_parse(self.zip.read(name)).findall(W + tag)):
                if note.get(W + "type") in ("separator", "continuationSeparator"):
                    continue
                for p in note.findall(W + "p"):
                    if (text := "".join(t.text or "" for t in p.iter(W + "t"))).strip():
                        yield "note", -k - 1, text

    @staticmethod
    def _visible(p: ET.Element) -> str:
        out, coded, hidden = [], False, False
        for e in p.iter():
            if e.tag == W + "fldChar":
                kind = e.get(W + "fldCharType")
                coded, hidden = (coded, coded) if kind == "separate" else (False, False)
            elif e.tag == W + "instrText":
                coded = coded or FIELD_KIND in (e.text or "")
            elif e.tag == W + "t" and not hidden:
                out.append(e.text or "")
        return "".join(out)

    def code(self, index: int, start: int, end: int, text: str, payload: str) -> bool:
        """Puts a field in the place of a span; False if no run of the paragraph itself lies under it."""
        if not 0 <= index < len(self.paragraphs):
            return False
        p = self.paragraphs[index]
        under = [r for r in self.runs(p) if r[1] < end and r[2] > start and r[0] in list(p)]
        if not under:
            return False
        (first, a, _), (last, b, _) = under[0], under[-1]
        new = [self._with_text(first, t) for t in [self.run_text(first)[: max(0, start - a)]] if t]
        new += self._field(first.find(W + "rPr"), text, payload)
        new += [self._with_text(last, t) for t in [self.run_text(last)[max(0, end - b) :]] if t]
        at = list(p).index(first)
        for run, _, _ in under:
            p.remove(run)
        p[at:at] = new
        return True

    @staticmethod
    def _with_text(run: ET.Element, text: str) -> ET.Element:
        run = copy.deepcopy(run)
        for t in run.findall(W + "t"):
            run.remove(t)
        ET.SubElement(run, W + "t", {PRESERVE: "preserve"}).text = text
        return run

    @staticmethod
    def _field(style: ET.Element | None, text: str, payload: str) -> list[ET.Element]:
        out = []
        for tag, value in (("fldChar", "begin"), ("instrText", f" {FIELD_HEAD} {payload} "), ("fldChar", "separate"), ("t", text), ("fldChar", "end")):
            run = ET.Element(W + "r")
            if style is not None:
                run.append(copy.deepcopy(style))
            e = ET.SubElement(run, W + tag, {W + "fldCharType": value} if tag == "fldChar" else {PRESERVE: "preserve"})
            if tag != "fldChar":
                e.text = value
            out.append(run)
        return out

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i in self.zip.infolist():
                z.writestr(i, ET.tostring(self.root, encoding="UTF-8", xml_declaration=True) if i.filename == self.part else self.zip.read(i.filename))
        return out.getvalue()


class OpenText(Word):
    """An .odt file."""

    part = "content.xml"

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.root = _parse(self.zip.read(self.part))
        inside = {p for tag in NOTE_BODIES for n in self.root.iter(tag) for p in n.iter(TEXT + "p")}
        every = list(self.root.iter(TEXT + "p"))
        self.paragraphs = [p for p in every if p not in inside]
        self.notes = [p for p in every if p in inside]

    def _pieces(self, e: ET.Element) -> Iterator[tuple[ET.Element, str]]:
        """(element, "text" or "tail") of the text nodes in order, without those of notes."""
        yield e, "text"
        for child in e:
            if child.tag != TEXT + "note":
                yield from self._pieces(child)
            yield child, "tail"

    def texts(self) -> Iterator[tuple[str, int, str]]:
        for k, p in enumerate(self.paragraphs):
            yield "body", k, "".join(getattr(e, at) or "" for e, at in self._pieces(p))
        for k, p in enumerate(self.notes):
            if (text := "".join(p.itertext())).strip():
                yield "note", -k - 1, text

    def code(self, index: int, start: int, end: int, text: str, payload: str) -> bool:
        """Puts reference marks around a span that lies in one text node; False for any other."""
        if not 0 <= index < len(self.paragraphs):
            return False
        at, p = 0, self.paragraphs[index]
        for e, kind in self._pieces(p):
            data = getattr(e, kind) or ""
            if data and at <= start and end <= at + len(data):
                name = {TEXT + "name": f"{MARK_HEAD} {payload}"}
                opening, closing = ET.Element(TEXT + "reference-mark-start", name), ET.Element(TEXT + "reference-mark-end", name)
                opening.tail, closing.tail = data[start - at : end - at], data[end - at :]
                setattr(e, kind, data[: start - at])
                parent, k = (e, 0) if kind == "text" else (_parents(p)[e], list(_parents(p)[e]).index(e) + 1)
                parent[k:k] = [opening, closing]
                return True
            at += len(data)
        return False


def opened(path: str, data: bytes) -> Word:
    return (OpenText if path.lower().endswith(".odt") else Word)(data)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def paragraphs(documents: DataFrame) -> DataFrame:
    """Rows of binaryFile (path, content) to SCHEMA; a file that can't be read gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = list(opened(path, data).texts())
                except (zipfile.BadZipFile, KeyError, ET.ParseError, AttributeError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_pydict({"path": [path] * len(rows), "zone": [r[0] for r in rows], "para_idx": pa.array([r[1] for r in rows], pa.int32()), "para_text": [r[2] for r in rows]})

    return documents.select("path", "content").mapInArrow(run, SCHEMA)


def coded(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, n_written): documents with edits (path, para_idx, char_start, char_end, text, payload) as fields, written from the end of each paragraph back."""
    one = F.struct("para_idx", (-F.col("char_start")).alias("back"), "char_start", "char_end", "text", "payload")
    by_path = edits.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data, todo in zip(*(b.column(c).to_pylist() for c in ("path", "content", "edits")), strict=True):
                n = 0
                if todo:  # a file that can't be read has no edits, and stays as it is
                    doc = opened(path, data)
                    n = sum(doc.code(e["para_idx"], e["char_start"], e["char_end"], e["text"], e["payload"]) for e in todo)
                    data = doc.save()
                yield pa.RecordBatch.from_pydict({"path": [path], "content": pa.array([data], pa.binary()), "n_written": pa.array([n], pa.int32())})

    return documents.select("path", "content").join(by_path, "path", "left").mapInArrow(run, "path string, content binary, n_written int")


def save_files(documents: DataFrame, folder: str) -> int:
    """Writes each row's content to a folder that all executors mount, under its path below the folder that all documents have in common; returns how many."""
    import os

    ends = documents.agg(F.min("path"), F.max("path")).first()
    if ends[0] is None:
        return 0
    common = len(os.path.commonprefix(list(ends)).rpartition("/")[0]) + 1 if ends[0] != ends[1] else ends[0].rfind("/") + 1

    def run(rows: Iterator) -> Iterator[int]:
        n = 0
        for r in rows:
            target = os.path.join(folder, r["path"][common:].lstrip("/"))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(f"{target}.part", "wb") as f:
                f.write(r["content"])
            os.replace(f"{target}.part", target)  # a task that runs again leaves no half a file
            n += 1
        yield n

    os.makedirs(folder, exist_ok=True)
    return sum(documents.select("path", "content").rdd.mapPartitions(run).collect())
