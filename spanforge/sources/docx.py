"""Word documents as blocks of text with runs, and back.

Files are read by Spark's binaryFile source, so any store that Spark reads will do, and parsed in Python workers with
the standard library: a .docx is a zip of XML. Blocks come in the order body paragraphs, table cells, then header and
footer of each section; paragraph numbers count empty ones. Text in hyperlinks, nested tables, text boxes, footnotes
and comments is not part of a block; a merged cell and a header that a section inherits appear once. Rewriting changes
only the runs whose text changed and copies every other part byte for byte.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.dom import minidom

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import BLOCKS

MAIN = "word/document.xml"
LOCATION_KEYS = ("type", "para_idx", "table_idx", "row_idx", "col_idx", "section_idx")


def _children(node, name: str) -> list:
    return [c for c in node.childNodes if c.nodeName == name]


def _run_text(run) -> str:
    signs = {"w:tab": "\t", "w:br": "\n", "w:cr": "\n", "w:noBreakHyphen": "-"}
    return "".join("".join(t.data for t in c.childNodes if t.nodeType == t.TEXT_NODE) if c.nodeName == "w:t" else signs.get(c.nodeName, "") for c in run.childNodes)


def _attributes(run) -> dict[str, str]:
    marks = [c for p in _children(run, "w:rPr") for c in p.childNodes if c.nodeName in ("w:b", "w:i", "w:u")]
    return {m.nodeName[2:]: m.getAttribute("w:val") or "1" for m in marks}


def _paragraphs(parts: dict[str, minidom.Document]) -> Iterator[tuple[str, object, dict]]:
    """(part, paragraph, location) in reading order, empty paragraphs too."""
    body = parts[MAIN].getElementsByTagName("w:body")[0]
    for i, p in enumerate(_children(body, "w:p")):
        yield MAIN, p, {"type": "paragraph", "para_idx": i}
    for t, table in enumerate(_children(body, "w:tbl")):
        for r, row in enumerate(_children(table, "w:tr")):
            for c, cell in enumerate(_children(row, "w:tc")):
                for i, p in enumerate(_children(cell, "w:p")):
                    yield MAIN, p, {"type": "table_cell", "table_idx": t, "row_idx": r, "col_idx": c, "para_idx": i}
    links = {}
    if "word/_rels/document.xml.rels" in parts:
        for r in parts["word/_rels/document.xml.rels"].getElementsByTagName("Relationship"):
            links[r.getAttribute("Id")] = "word/" + r.getAttribute("Target").removeprefix("/word/")
    for s, section in enumerate(parts[MAIN].getElementsByTagName("w:sectPr")):
        for kind in ("header", "footer"):
            for reference in _children(section, f"w:{kind}Reference"):
                part = links.get(reference.getAttribute("r:id"))
                if reference.getAttribute("w:type") in ("", "default") and part in parts:
                    for i, p in enumerate(_children(parts[part].documentElement, "w:p")):
                        yield part, p, {"type": kind, "section_idx": s, "para_idx": i}


def _parts(content: bytes) -> dict[str, minidom.Document]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        wanted = [n for n in z.namelist() if n == MAIN or n == "word/_rels/document.xml.rels" or n.startswith(("word/header", "word/footer")) and n.endswith(".xml")]
        return {n: minidom.parseString(z.read(n)) for n in wanted}


def blocks_of(doc_id: str, content: bytes) -> Iterator[dict]:
    """Blocks with text other than white space; block_seq counts all paragraphs, so it finds them again."""
    for seq, (_, paragraph, location) in enumerate(_paragraphs(_parts(content))):
        runs, at = [], 0
        for i, run in enumerate(_children(paragraph, "w:r")):
            text = _run_text(run)
            runs.append({"idx": i, "text": text, "start": at, "attrs": list(_attributes(run).items())})
            at += len(text)
        text = "".join(r["text"] for r in runs)
        if text.strip():
            yield {"doc_id": doc_id, "block_seq": seq, "text": text, "location": {k: location.get(k) for k in LOCATION_KEYS}, "runs": runs}


def rewritten(content: bytes, changes: dict[int, list[str]]) -> bytes:
    """The document with new run texts for the blocks of `changes` (block_seq to texts)."""
    parts = _parts(content)
    touched = set()
    for seq, (part, paragraph, _) in enumerate(_paragraphs(parts)):
        for run, text in zip(_children(paragraph, "w:r"), changes.get(seq, ()), strict=False):
            if _run_text(run) != text:
                touched.add(part)
                for c in [c for c in run.childNodes if c.nodeName != "w:rPr"]:
                    run.removeChild(c)
                node = parts[part].createElement("w:t")
                node.setAttribute("xml:space", "preserve")
                node.appendChild(parts[part].createTextNode(text))
                run.appendChild(node)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for entry in old.infolist():
            new.writestr(entry, parts[entry.filename].toxml(encoding="UTF-8") if entry.filename in touched else old.read(entry.filename))
    return out.getvalue()


def make_docx(paragraphs: list[list[str]], tables: list[list[list[str]]] = (), header: str | None = None) -> bytes:
    """A small document of paragraphs (lists of run texts), tables (rows of cell texts) and one header."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    p = lambda runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in runs) + "</w:p>"
    body = "".join(map(p, paragraphs))
    for table in tables:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p([cell])}</w:tc>" for cell in row) + "</w:tr>" for row in table) + "</w:tbl>"
    body += "<w:sectPr>" + ('<w:headerReference w:type="default" r:id="rId1"/>' if header else "") + "</w:sectPr>"
    types = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", rels.format(f'<Relationship Id="rId1" Type="{kind}officeDocument" Target="word/document.xml"/>'))
        z.writestr(MAIN, f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/_rels/document.xml.rels", rels.format(f'<Relationship Id="rId1" Type="{kind}header" Target="header1.xml"/>'))
            z.writestr("word/header1.xml", f"<w:hdr {ns}>{p([header])}</w:hdr>")
    return out.getvalue()


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of the .docx files under a path; doc_id is the file's path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), "content")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all .docx files under a path."""
    return parse_docx(files(spark, path))


def parse_docx(contents: DataFrame) -> DataFrame:
    """Blocks of documents (doc_id, content)."""

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := list(blocks_of(doc_id, content)):
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())

    return contents.select("doc_id", "content").mapInArrow(run, BLOCKS)


def _arrow_schema() -> pa.Schema:
    location = pa.struct([(k, pa.string() if k == "type" else pa.int32()) for k in LOCATION_KEYS])
    run = pa.struct([("idx", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string()))])
    return pa.schema([("doc_id", pa.string()), ("block_seq", pa.int32()), ("text", pa.string()), ("location", location), ("runs", pa.list_(run))])


def rewrite_docx(contents: DataFrame, changed: DataFrame) -> DataFrame:
    """(doc_id, content) with the run texts of `changed` (doc_id, block_seq, runs) put in; files without a change too.

    A document's changed blocks meet in one row, which is the size of the document that they belong to.
    """
    texts = F.transform("runs", lambda r: r["text"])
    gathered = changed.groupBy("doc_id").agg(F.collect_list(F.struct("block_seq", texts.alias("texts"))).alias("changes"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                changes = {c["block_seq"]: c["texts"] for c in row["changes"] or ()}
                content = rewritten(row["content"], changes) if changes else row["content"]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]]), pa.array([content], pa.binary())], names=["doc_id", "content"])

    return contents.join(gathered, "doc_id", "left").select("doc_id", "content", "changes").mapInArrow(run, "doc_id string, content binary")


class DocxSource(DataSource):
    """`spark.read.format("docx").load(folder)` gives blocks, `df.write.format("docx")` writes (doc_id, content) files.

    For folders that all executors mount; other stores are read by `read_docx`.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        top = Path(self.path)
        return [InputPartition(str(p)) for p in ([top] if top.is_file() else sorted(top.rglob("*"))) if p.suffix.lower() == ".docx"]

    def read(self, partition: InputPartition):
        with open(partition.value, "rb") as f:
            rows = list(blocks_of(partition.value, f.read()))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow_schema())


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        import os

        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            name = os.path.join(self.path, os.path.basename(row["doc_id"]))
            with open(f"{name}.part", "wb") as f:
                f.write(row["content"])
            os.replace(f"{name}.part", name)  # a repeated task writes the same file again
        return WriterCommitMessage()
