from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.operators import pseudonym, rewrite, score, structured
from spanforge.operators.resolve import RANKS, only, resolve
from spanforge.schemas import MATCH


def matches(spark, lists):
    rows = [([{"text": "t", "category": c, "start": s, "end": e, "confidence": k, "needs_review": False, "detector": d, "seq": i} for i, (s, e, d, c, k) in enumerate(m)],) for m in lists]
    return spark.createDataFrame(rows, f"m array<{MATCH}>")


def brute_resolve(items):
    worth = lambda m: (-RANKS.get(m[2], 1), m[1] - m[0], m[4])
    kept = []
    for m in sorted(items, key=lambda m: m[:2]):
        if kept and kept[-1][0] < m[1] and m[0] < kept[-1][1]:
            if worth(m) > worth(kept[-1]):
                kept[-1] = m
        else:
            kept.append(m)
    return kept


def test_resolver_cases(spark):
    cases = [
        ([(0, 16, "regex", "EMAIL", 1.0), (0, 16, "ner", "PERSON", 0.8)], [(0, 16, "regex")]),
        ([(0, 11, "ner", "PERSON", 0.8), (12, 23, "ner", "PERSON", 0.8)], [(0, 11, "ner"), (12, 23, "ner")]),
        ([(0, 4, "ner", "PERSON", 0.8), (0, 10, "ner", "PERSON", 0.8)], [(0, 10, "ner")]),
        ([(0, 14, "regex", "PHONE", 1.0), (4, 17, "ner", "PERSON", 0.8)], [(0, 14, "regex")]),
        ([(k, k + 5, "ner", "PERSON", 0.8) for k in range(0, 50, 10)], [(k, k + 5, "ner") for k in range(0, 50, 10)]),
        ([(0, 10, "ner", "PERSON", 0.8), (5, 20, "regex", "EMAIL", 1.0), (15, 25, "ner", "PERSON", 0.8)], [(5, 20, "regex")]),
        ([], []),
    ]
    got = matches(spark, [c[0] for c in cases]).select(resolve(F.col("m")).alias("m")).collect()
    assert [[(m.start, m.end, m.detector) for m in r.m] for r in got] == [c[1] for c in cases]


def test_filter_comes_after(spark):
    rows = matches(spark, [[(0, 16, "regex", "EMAIL", 1.0), (0, 10, "ner", "PERSON", 0.8)]])
    assert rows.select(only(resolve(F.col("m")), ["person"])).first()[0] == []
    assert len(rows.select(only(resolve(F.col("m")), [])).first()[0]) == 1


SPAN = st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from(["regex", "ner", "heuristic", "other"]), st.sampled_from([0.5, 0.8]))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(SPAN, max_size=10), min_size=1, max_size=30))
def test_resolver_fold(spark, lists):
    lists = [[(s, s + n, d, "X", c) for s, n, d, c in m] for m in lists]
    got = matches(spark, lists).select(F.col("m"), resolve(F.col("m")).alias("r")).collect()
    for r in got:
        items = [(m.start, m.end, m.detector, "X", m.confidence) for m in r.m]
        assert [(m.start, m.end, m.detector, "X", m.confidence) for m in r.r] == brute_resolve(items)


VALUES = [("John Smith", "PERSON"), ("john@example.com", "EMAIL"), ("10.0.0.1", "IP"), ("123-45-6789", "SSN"), ("4111111111111111", "CREDIT_CARD"), ("15/03/1985", "DOB"), ("+91 98765 43210", "PHONE"), ("X Ltd", "COMPANY"), ("Plot 5", "ADDRESS"), ("Z1", "PASSPORT")]


def test_pseudonyms(spark):
    rows = spark.createDataFrame(VALUES * 3, "text string, category string")
    one, again, other = ({(r.text, r.category): r.fake for r in pseudonym.mapping(rows, seed).collect()} for seed in (42, 42, 99))
    assert one == again and one != other and len(one) == len(VALUES)
    fakes = [one[v] for v in VALUES]
    shown = spark.createDataFrame([(" | ".join(fakes),)], "text string")
    found = {m.category for m in shown.select(structured.detect_structured(F.col("text"))).first()[0]}
    assert {"EMAIL", "IP", "SSN", "CREDIT_CARD", "PHONE"} <= found
    assert fakes[6].startswith("+91 ") and fakes[5][2] == "/" and fakes[9] == "[REDACTED_PASSPORT]"
    assert fakes[2].rsplit(".", 1)[0] in pseudonym.NETWORKS


def test_all_ssn_and_card_fakes_are_valid(spark):
    rows = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("text"), F.explode(F.array(F.lit("SSN"), F.lit("CREDIT_CARD"))).alias("category"))
    fakes = pseudonym.mapping(rows)
    found = F.when(F.col("category") == "SSN", F.size(structured.ssn_spans(F.col("fake")))).otherwise(F.size(structured.card_spans(F.col("fake"))))
    assert fakes.where(found != 1).count() == 0


def test_compat_mapping_takes_first_category(spark):
    rows = spark.createDataFrame([("a", "EMAIL", 2), ("a", "PERSON", 1), ("b", "IP", 5)], "text string, category string, n int")
    assert {r.text: r.category for r in pseudonym.compat_mapping(rows, ["n"]).collect()} == {"a": "PERSON", "b": "IP"}


RUNS = [
    (["My name is John Smith and I live here."], "John Smith", "Jane Doe", ["My name is Jane Doe and I live here."]),
    (["Hello ", "John Smith", " goodbye"], "John Smith", "Jane Doe", ["Hello ", "Jane Doe", " goodbye"]),
    (["Director: Marta ", "Ilse Lindqvist", ", DIN 12345"], "Marta Ilse Lindqvist", "Aarav Mehta", ["Director: Aarav Mehta", "", ", DIN 12345"]),
    (["Ma", "rta Il", "se Lindqvist extra"], "Marta Ilse Lindqvist", "Priya Nair", ["Priya Nair", "", " extra"]),
    (["Start ", "John ", "Smith", " End"], "John Smith", "Jane", ["Start ", "Jane", "", " End"]),
]


def test_run_rewriting(spark):
    for texts, target, fake, expected in RUNS:
        start = "".join(texts).index(target)
        rows = spark.createDataFrame([(texts,)], "texts array<string>").withColumn("runs", rewrite.make_runs(F.col("texts")))
        m = F.array(F.struct(F.lit(start).alias("start"), F.lit(start + len(target)).alias("end"), F.lit(fake).alias("fake")))
        assert [r.text for r in rows.select(rewrite.rewrite_runs(F.col("runs"), m)).first()[0]] == expected


def test_run_offsets(spark):
    rows = spark.createDataFrame([(["Hello ", "world", "!"],), ([],)], "t array<string>")
    assert [r[0] for r in rows.select(rewrite.run_starts(F.col("t"))).collect()] == [[0, 6, 11], []]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab é😀", max_size=8), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.integers(1, 9)), max_size=5))
def test_text_and_run_rewriting_agree(spark, texts, gaps):
    text, spans, at = "".join(texts), [], 0
    for i, (gap, n) in enumerate(gaps):
        start, end = at + gap, at + gap + n
        if end > len(text):
            break
        spans.append((start, end, None if i == 3 else f"<{i}>"))
        at = end
    expected, at = "", 0
    for s, e, f in spans:
        if f:
            expected, at = expected + text[at:s] + f, e
    expected += text[at:]
    rows = spark.createDataFrame([(texts, text, spans)], "texts array<string>, text string, m array<struct<start:int,end:int,fake:string>>")
    rows = rows.withColumn("runs", rewrite.make_runs(F.col("texts")))
    r = rows.select(rewrite.rewrite_text(F.col("text"), F.col("m")).alias("t"), rewrite.run_text(rewrite.rewrite_runs(F.col("runs"), F.col("m"))).alias("r")).first()
    assert (r.t, r.r) == (expected, expected)


FIELDS = "id int, text string, category string, para_idx int, start_char int"


def brute_pairs(dets, truth, tolerance):
    free, pairs = list(truth), []
    norm = lambda t: " ".join(t.lower().split())
    for d in dets:
        for g in free:
            place = d[3] == g[3] if d[3] is not None and g[3] is not None else abs(d[4] - g[4]) <= tolerance if d[4] is not None and g[4] is not None else True
            if d[2].upper() == g[2].upper() and norm(d[1]) == norm(g[1]) and place:
                pairs.append((d[0], g[0]))
                free.remove(g)
                break
    return sorted(pairs)


RECORD = st.tuples(st.sampled_from(["A b", "a  B ", "c"]), st.sampled_from(["EMAIL", "email", "IP"]), st.sampled_from([None, 0, 1]), st.sampled_from([None, 0, 8, 25]))


@settings(max_examples=12, deadline=None)
@given(st.lists(RECORD, max_size=14), st.lists(RECORD, max_size=14), st.sampled_from([10, 20]))
def test_greedy_matching(spark, dets, truth, tolerance):
    dets, truth = ([(i, *r) for i, r in enumerate(rows)] for rows in (dets, truth))
    got = score.match_pairs(spark.createDataFrame(dets, FIELDS), spark.createDataFrame(truth, FIELDS), tolerance).collect()
    assert sorted((r.det_id, r.truth_id) for r in got) == brute_pairs(dets, truth, tolerance)


def test_score_cases(spark):
    def one(dets, truth):
        out = score.consistent(score.score(spark.createDataFrame(dets, FIELDS), spark.createDataFrame(truth, FIELDS)))
        return {r.category: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in out.collect()}

    alice, bob, wrong = (1, "alice@x.com", "EMAIL", 0, 0), (2, "bob@x.com", "EMAIL", 1, 0), (3, "wrong@x.com", "EMAIL", 2, 0)
    assert one([alice], [alice])["EMAIL"] == (1, 0, 0, 1.0, 1.0)
    assert one([alice], [])["EMAIL"] == (0, 1, 0, 0.0, None)
    assert one([], [alice])["EMAIL"] == (0, 0, 1, None, 0.0)
    got = one([alice, bob, wrong], [alice, bob])
    assert got["EMAIL"] == (2, 1, 0, 2 / 3, 1.0) and got["SSN"] == (0, 0, 0, None, None)
    assert got["OVERALL"] == (2, 1, 0, 2 / 3, 1.0) and len(got) == 10


def test_equal_places_resolve_alike_in_any_order_of_rows(spark):
    """Matches of one place, number and worth: which one stays does not depend on the order in which they come."""
    made = [(c, c, 1, 5, 0.5, False, "ner", 3) for c in ("EMAIL", "PERSON", "PHONE")]
    rows = spark.createDataFrame([(made,), (made[::-1],), (made[1:] + made[:1],)], f"matches array<{MATCH}>")
    got = [[m.category for m in r[0]] for r in rows.select(resolve(F.col("matches"))).collect()]
    assert got == [["EMAIL"]] * 3
