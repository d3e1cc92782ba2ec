from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanforge import cli
from spanforge.operators.detect import collect_matches, exploded
from spanforge.plans.redaction import redact_blocks, wanted_categories
from spanforge.sources import docx, records, tables
from spanforge.streaming import redaction as streaming


@pytest.fixture()
def folder(tmp_path):
    one = docx.make_docx([["Mail ", "alice@exam", "ple.com now"], [""], ["Nothing here"]], [[["Cell 10.0.0.1", "x"]]], "Head bob@example.org")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.docx").write_bytes(one)
    (tmp_path / "in" / "two.DOCX").write_bytes(docx.make_docx([["Card 4111 1111 1111 1111."]]))
    (tmp_path / "in" / "other.txt").write_text("a@b.co")
    return tmp_path


def test_docx_blocks(spark, folder):
    rows = docx.read_docx(spark, str(folder / "in")).where("doc_id like '%one.docx'").orderBy("block_seq").collect()
    assert [(r.text, r.location.type, r.location.para_idx) for r in rows] == [
        ("Mail alice@example.com now", "paragraph", 0), ("Nothing here", "paragraph", 2), ("Cell 10.0.0.1", "table_cell", 0), ("x", "table_cell", 0), ("Head bob@example.org", "header", 0),
    ]
    assert [(r.text, r.start) for r in rows[0].runs] == [("Mail ", 0), ("alice@exam", 5), ("ple.com now", 15)]
    spark.dataSource.register(docx.DocxSource)
    assert spark.read.format("docx").load(str(folder / "in")).count() == 6


def test_redact_command(spark, folder):
    out, found = str(folder / "out"), str(folder / "found")
    assert cli.main(["redact", "-i", str(folder / "in"), "-o", out, "--detections-out", found, "--categories", "email, ip,credit_card"]) == 0
    texts = " ".join(r.text for r in docx.read_docx(spark, out).collect())
    assert "alice@" not in texts and "bob@example.org" not in texts and "4111" not in texts and "10.0.0.1" not in texts and "Nothing here" in texts
    detections = records.read_detections(spark, found).collect()
    assert sorted(d.text for d in detections) == ["10.0.0.1", "4111 1111 1111 1111", "alice@example.com", "bob@example.org"]
    assert [d.source_location.run_offsets for d in detections if d.text.startswith("alice")] == [[0, 5, 15]]
    truth = folder / "truth.json"
    truth.write_text(json.dumps([{"text": "ALICE@example.com", "category": "email", "para_idx": 0}, {"text": "gone@x.org", "category": "EMAIL"}]))
    report = folder / "report.md"
    assert cli.main(["evaluate", "--detections", found, "--ground-truth", str(truth), "--report", str(report), "--tables", str(folder / "tables")]) == 0
    assert "| EMAIL | 2 | 2 | 1 | 1 | 1 | 0.500 ✗ | 0.500 ✗ | 0.500 |" in report.read_text()
    assert spark.read.option("header", True).csv(str(folder / "tables/csv/metrics")).count() == 10
    assert cli.main(["ground-truth", "--detections", found, "--output", str(folder / "candidates")]) == 0
    assert spark.read.json(str(folder / "candidates")).count() == 4


def test_dry_run_and_errors(spark, folder, capsys):
    assert cli.main(["redact", "-i", str(folder / "in"), "-o", str(folder / "no"), "--detections-out", str(folder / "d"), "--dry-run"]) == 0
    assert not (folder / "no").exists() and (folder / "d").exists()
    assert cli.main(["redact", "-i", str(folder / "missing")]) == 1
    assert cli.main(["redact", "-i", str(folder / "in"), "--categories", "EMAIL,NOPE"]) == 1
    with pytest.raises(ValueError, match="NOPE"):
        wanted_categories("nope")
    bad = folder / "bad.json"
    bad.write_text(json.dumps([{"category": "EMAIL"}]))
    with pytest.raises(Exception, match="needs text and category"):
        records.read_truth(spark, str(bad)).collect()


def test_blocks(spark):
    rows = spark.createDataFrame([(1, "a\n \nb"), (2, None), (3, "  "), (4, "")], "id int, text string")
    assert [(r.doc_id, r.block_seq, r.text) for r in tables.line_blocks(rows, "id").collect()] == [(1, 0, "a"), (1, 2, "b")]
    assert tables.text_blocks(rows, "id").count() == 1
    assert [r.text for r in tables.run_blocks(rows, "id").first().runs] == ["a\n", " \n", "b"]


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"mail a{i % 3}@x.org or 10.0.0.{i}", f"2024-01-01 00:{i:02d}:00") for i in range(30)], "doc_id int, text string, t string")
    rows = rows.select("doc_id", "text", F.col("t").cast("timestamp").alias("ts"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.to_parquet(streaming.redact_stream(stream, entities=None).select("doc_id", "new_text"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = redact_blocks(rows, entities=None).select("doc_id", "new_text").collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch))
    for name, make in {"w": streaming.windowed_counts, "f": streaming.first_seen, "s": lambda m: streaming.session_counts(m, "doc_id")}.items():
        counted = make(collect_matches(stream, entities=None))
        streaming.to_parquet(counted, str(tmp_path / f"o{name}"), str(tmp_path / f"s{name}")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / f"o{name}"))
        assert got.count() > 0
    first = spark.read.parquet(str(tmp_path / "of")).where("category = 'EMAIL'")
    assert sorted(r.text for r in first.collect()) == ["a0@x.org", "a1@x.org", "a2@x.org"]


def test_web(spark):
    import threading
    import urllib.error
    import urllib.request

    from spanforge.web import serve

    server = serve(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    assert b"<form" in urllib.request.urlopen(f"{top}/").read()

    def post(name, content):
        body = b'--x\r\nContent-Disposition: form-data; name="file"; filename="' + name + b'"\r\n\r\n' + content + b"\r\n--x--\r\n"
        return urllib.request.urlopen(urllib.request.Request(f"{top}/redact", body, {"Content-Type": "multipart/form-data; boundary=x"}))

    reply = post(b"a.docx", docx.make_docx([["Mail alice@example.com"]]))
    assert "redacted_a.docx" in reply.headers["Content-Disposition"]
    texts = [b["text"] for b in docx.blocks_of("d", reply.read())]
    assert len(texts) == 1 and "alice" not in texts[0] and texts[0].startswith("Mail ")
    for name, content, status in ((b"a.txt", b"x", 415), (b"a.docx", b"x", 422)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(name, content)
        assert e.value.code == status
    server.shutdown()


def test_reports_and_charts(spark):
    from spanforge.operators import score
    from spanforge.plans import charts, evaluation

    fields = "id int, text string, category string, para_idx int, start_char int"
    found = spark.createDataFrame([(1, "a@b.co", "EMAIL", 0, 0), (2, "x", "IP", 0, 0)], fields)
    truth = spark.createDataFrame([(1, "A@b.co", "EMAIL", 0, 0), (2, "y", "IP", 1, 0)], fields)
    tables_ = evaluation.evaluate(found, truth)
    text = evaluation.outcome_report(tables_)
    assert "found and true: 1" in text and "IP: 1 false, 1 missed" in text and "missed: 'y'" in text
    made = charts.charts(score.score(found, truth), tables_["distribution"], tables_["coverage"])
    assert len(made) == 5 and all(c.startswith("<svg") and c.count("<rect") for c in made.values())


def test_reports_list_all_missed(spark):
    from spanforge.plans import evaluation

    fields = "id int, text string, category string, para_idx int, start_char int"
    found = spark.createDataFrame([(i, f"f{i}.", "IP", i, 0) for i in range(25)], fields)
    truth = spark.createDataFrame([(i, f"m{i}.", "IP", 100 + i, 0) for i in range(30)], fields)
    tables_ = evaluation.evaluate(found, truth)
    for text in (evaluation.report(tables_), evaluation.outcome_report(tables_)):
        assert all(f"'m{i}.'" in text for i in range(30))
        assert [f"'f{i}.'" in text for i in range(25)] == [True] * 20 + [False] * 5
    stored = evaluation.full_result(tables_)
    assert stored["false_positives"].count() == stored["false_negatives"].count() == 10


def test_full_evaluation_of_two_documents(spark, tmp_path):
    """Equal texts at equal places in two documents are told apart; every error is in the tables, ten in the files."""
    from spanforge import cli

    record = lambda doc, text, para: {"doc_id": doc, "text": text, "category": "IP", "start_char": 0, "end_char": 5, "source_location": {"type": "paragraph", "para_idx": para}, "confidence": 1.0, "needs_review": False, "detector": "regex"}
    found = [record("a", "10.0.0.1", 3), record("b", "10.0.0.2", 3)] + [record("a", f"9.9.9.{i}", i) for i in range(25)]
    truth = [{"doc_id": "b", "text": "10.0.0.1", "category": "IP", "para_idx": 3}, {"doc_id": "b", "text": "10.0.0.2", "category": "IP", "para_idx": 3}] + [{"doc_id": "b", "text": f"8.8.8.{i}", "category": "IP", "para_idx": i} for i in range(25)]
    (tmp_path / "found.json").write_text(json.dumps(found))
    (tmp_path / "truth.json").write_text(json.dumps(truth))
    args = ["evaluate", "--detections", str(tmp_path / "found.json"), "--ground-truth", str(tmp_path / "truth.json"), "--report", str(tmp_path / "r.md"), "--tables", str(tmp_path / "t")]
    assert cli.main(args) == 0
    report = (tmp_path / "r.md").read_text()
    assert "| IP | 27 | 27 | 1 | 26 | 26 |" in report and all(f"'8.8.8.{i}'" in report for i in range(25)) and report.count("'9.9.9.") + report.count("'10.0.0.1'") == 20 + 1
    full = json.loads((tmp_path / "t" / "evaluation_results.json").read_text())
    assert full["IP"]["TP"] == 1 and len(full["IP"]["fp_examples"]) == len(full["IP"]["fn_examples"]) == 10 and full["OVERALL"]["FN"] == 26
    assert json.loads((tmp_path / "t" / "overall_metrics.json").read_text())["total_ground_truth"] == 27
    assert json.loads((tmp_path / "t" / "per_category_metrics.json").read_text())["EMAIL"]["has_ground_truth"] is False
    # Without documents in one file, places alone decide.
    (tmp_path / "truth.json").write_text(json.dumps([{k: v for k, v in t.items() if k != "doc_id"} for t in truth]))
    assert cli.main(args) == 0 and "| IP | 27 | 27 | 2 | 25 | 25 |" in (tmp_path / "r.md").read_text()


def test_detections_as_one_array(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 1), ("b", 'y "z"', 2)], "doc_id string, text string, start_char int")
    records.write_detections(rows, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == [{"doc_id": "a", "text": "x", "start_char": 1}, {"doc_id": "b", "text": 'y "z"', "start_char": 2}]
    records.write_detections(rows.where("false"), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == []


def test_entities_by_a_model(spark):
    """A model is loaded in the workers, gets many texts at once and fills the entities that detectors judge."""
    from spanforge.operators.models import preceding, spacy_loader, with_entities

    def load():
        import re

        return lambda texts: [[(m[0], "PERSON", m.start(), m.end()) for m in re.finditer("[a-z]+ lee", t)] for t in texts]

    texts = ["signed by ana lee and bo lee", None, "", "one  two\nthree four five six  cy lee"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    marked = with_entities(rows, load)
    got = {r.doc_id: [(e.text, e.start, e.preceding) for e in r.entities] for r in marked.collect()}
    assert got == {0: [("ana lee", 10, "signed by"), ("bo lee", 22, "signed by ana lee and")], 1: [], 2: [], 3: [("cy lee", 30, "two three four five six")]}
    found = exploded(collect_matches(marked, entities="entities"), "doc_id").collect()
    assert sorted((r.doc_id, r.text, r.confidence) for r in found) == [(0, "ana lee", 0.9), (0, "bo lee", 0.9), (3, "cy lee", 0.8)]
    assert preceding("", 0) == preceding("   ", 3) == ""
    with pytest.raises(RuntimeError, match="not installed"):
        spacy_loader("no_such_model")()


def test_own_detector(spark):
    from spanforge.functions.expressions import as_match, spans
    from spanforge.operators import structured

    structured.register_detector("TICKET", lambda text: F.transform(spans(text, r"TK-\d+"), lambda s: as_match(s, "TICKET", 1.0, "regex")))
    try:
        rows = spark.createDataFrame([("see TK-123",)], "text string")
        assert [m.category for m in collect_matches(rows, entities=None).first().matches] == ["TICKET"]
    finally:
        del structured.DETECTORS["TICKET"]
