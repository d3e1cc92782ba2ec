"""Near-duplicates, mixing, language, LM scores, search and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import components, langid, lm_scoring, maxscore, minhash, mixing
from spanforge.llm.shingles import shingle_sets

from llm_rows import AWKWARD, table

SPACE = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def brute_set(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def brute_groups(docs):
    """(doc_id, number of shingles, smallest reachable id) by comparing all pairs."""
    sets = [brute_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


def made_corpus(seed, n=260):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randrange(1, 5)))
    common = [word() for _ in range(12)]
    docs = []
    for i in range(n):
        if docs and draw.random() < 0.6:
            base = draw.choice(docs)[1].split() or ["x"]
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                base[draw.randrange(len(base))] = word()
            text = " ".join(base)
        else:
            text = " ".join([word() for _ in range(draw.randrange(0, 40))] + (common if draw.random() < 0.3 else []))
        docs.append((i * 7 % 1009, text.upper() if draw.random() < 0.2 else text))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    docs = made_corpus(seed)
    rows = table(spark, [(i, t, None, None) for i, t in docs])
    got = minhash.near_duplicates(rows).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_awkward(spark, awkward, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(awkward).collect()]
    by = {d: (n, c, k) for d, n, c, k in got}
    assert len(got) == len(AWKWARD)
    assert by[1] == (5, -5, False) and by[2] == (5, -5, False) and by[-5] == (6, -5, True)
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True)
    assert by[6] == (1, 6, True) and by[7] == (1, 6, False)
    assert [x for x in got if x[0] is None and x[1]] == [(None, 7, None, True)]
    assert minhash.near_duplicates(nothing).count() == 0


def test_one_large_group(spark):
    """A text with many edited copies that are no near copies of one another all the time."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 150):
        copy = list(base)
        for _ in range(3):
            copy[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    got = minhash.near_duplicates(table(spark, [(i, t, None, None) for i, t in docs])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(docs)


def test_copies_without_their_original(spark):
    """Edited copies of a text that is not there: most share buckets, few are links, and many links avoid the centres."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(900):
        copy = list(base)
        for at in draw.sample(range(120), 5):
            copy[at] = f"x{draw.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    got = minhash.near_duplicates(table(spark, [(i, t, None, None) for i, t in docs])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(docs)


def test_one_id_with_different_texts(spark):
    """Each text under a shared id has an edited copy of its own."""
    draw = random.Random(8)
    docs = []
    for i in range(60):
        text = [f"t{i}w{k}" for k in range(40)]
        copy = list(text)
        copy[draw.randrange(40)] = "other"
        docs += [(i % 6, " ".join(text)), (100 + i, " ".join(copy))]
    got = minhash.near_duplicates(table(spark, [(i, t, None, None) for i, t in docs])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(docs)


def test_one_row_of_each_group_stays(spark):
    """Ids that name several texts, equal rows, rows without an id: one row for each group by brute force."""
    draw = random.Random(9)
    docs = []
    for i in range(40):
        text = [f"t{i}w{k}" for k in range(40)]
        for _ in range(draw.randrange(1, 4)):
            copy = list(text)
            copy[draw.randrange(40)] = "other"
            docs.append((draw.choice([None, i % 4, 100 + draw.randrange(9)]), " ".join(copy)))
            docs += [docs[-1]] * draw.randrange(2)
    docs += [(None, "alone without id"), (50, ""), (50, None), (50, "")]
    got = minhash.one_of_each(table(spark, [(i, t, None, None) for i, t in docs]))
    assert got.columns == table(spark, []).columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    full = [(n, t) for n, (_, t) in enumerate(docs)]
    groups = {}
    for n, _, root in brute_groups(full):
        groups.setdefault(root, []).append(docs[n])
    for members in groups.values():
        stay = [r for r in rows if r in members]
        if brute_set(members[0][1]):
            named = [i for i, _ in members if i is not None]
            assert len(stay) == 1 and stay[0][0] == (min(named) if named else None)
    assert sum(1 for _, t in rows if brute_set(t)) == sum(1 for m in groups.values() if brute_set(m[0][1]))
    assert sum(i == 50 for i, _ in rows) == 1


def test_shingles_of_five_words():
    texts = [b"a b c d e f", b"A  b c\td e f", b"a b c", b"a b c d e g", b""]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    sets = [set(s.tolist()) for s in shingle_sets(raw, at, 5)]
    assert [len(s) for s in sets] == [2, 2, 1, 2, 0] and sets[0] == sets[1] and len(sets[0] & sets[3]) == 1


def test_densified_sketches_estimate_similarity():
    random_sets = np.random.default_rng(0).integers(0, 2**63, (200, 30), dtype=np.uint64)
    a, b = [np.sort(s[:27]) for s in random_sets], [np.sort(s[3:]) for s in random_sets]
    agree = (minhash.sketches(a) == minhash.sketches(b)).mean()
    assert abs(agree - 24 / 30) < 0.02


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, **dict.fromkeys(range(200, 230), 200)}
    assert len(got) == 41 + 2 + 30


def brute_targets(sizes):
    """Shares by weight, the excess above three times a size reshared until none is above."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        target |= {s: 3 * sizes[s] for s in over}


def test_mix(spark, awkward, nothing):
    draw = random.Random(5)
    rows = AWKWARD + [(100 + i, "w " * draw.randrange(1, 60), "en", draw.choice(["a", "b", "e", "f", "ü"])) for i in range(200)] + [(999, "v " * 3000, "en", "g")]
    mixed = mixing.mix(mixing.sized(table(spark, rows)), parts=4)
    got = mixed.select("row.doc_id", F.col("row.source").alias("source"), "size", "source_size", "target", "taken").collect()
    again = mixing.mix(mixing.sized(table(spark, rows[::-1])), parts=1).select("row.doc_id", "taken").collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    wanted = brute_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - wanted[s]) < 1e-6 * max(1, wanted[s]) and r.source_size == sizes[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - wanted[s]) <= 0.5 + 1e-9
    assert all(0 <= r.taken <= 3 * r.size for r in got) and len(got) == len(rows)
    out = mixing.expand(table(spark, rows), parts=4)
    assert out.columns == awkward.columns
    taken = Counter()
    for r in out.collect():
        taken[r.source] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert taken == Counter({s: round(wanted[s]) for s in sizes if round(wanted[s])})
    assert mixing.mix(mixing.sized(nothing)).count() == 0 and mixing.expand(nothing).count() == 0


def test_mix_of_equal_rows_and_ids(spark, monkeypatch):
    """A cut inside many equal rows, and sources whose rows have one id or none; words are placed as a plain loop does."""
    monkeypatch.setattr(mixing, "PART_ROWS", 16)
    draw = random.Random(6)
    rows = [(5, "a b c d e", "en", "a")] * 300 + [(None, "w " * draw.randrange(1, 9), "en", "b") for _ in range(150)] + [(9, f"x{i} y z", "en", "c") for i in range(20)]
    for parts in (None, 1, 7):
        got = mixing.mix(mixing.sized(table(spark, rows)), parts).select("row.source", "size", "taken", "target").collect()
        for name in "abc":
            mine = [r for r in got if r.source == name]
            assert len(mine) == sum(r[3] == name for r in rows)
            assert sum(r.taken for r in mine) == round(mine[0].target) and all(0 <= r.taken <= 3 * r.size for r in mine)
            epochs = round(mine[0].target) // sum(r.size for r in mine)
            assert sum(r.taken not in (epochs * r.size, (epochs + 1) * r.size) for r in mine) <= 1
    made = mixing.expand(table(spark, rows)).collect()
    for name in "abc":
        assert sum(len(words(r.text)) for r in made if r.source == name) == sum(r.taken for r in got if r.source == name)


def language_rows():
    draw = random.Random(2)
    parts = {"en": ["the", "and", "ing", "tion", "re"], "de": ["sch", "ein", "ung", "der", "ü"], "es": ["ción", "os", "ado", "que", "ñ"]}
    rows = []
    for i in range(600):
        lang = draw.choice(list(parts))
        text = " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(4, 60)))
        rows.append((i, text, lang, "s"))
    return rows


def test_language_id(spark, nothing):
    rows = language_rows()
    extra = [(1000, None, "en", None), (1001, "", "de", None), (1002, "123 !!", "es", None), (None, "sch ein der ung sch", None, None)]
    docs = table(spark, rows + extra)
    model = langid.fit(docs)
    assert np.isfinite(model.temperature) and (model.weights == 0).mean() > 0.5
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    truth = {i: lang for i, _, lang, _ in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out == (i in held) for i in truth)
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.97
    assert [(out[i].lang_pred, out[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert out[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in out.values())
    kept = langid.filter_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 1
    empty = langid.fit(nothing)
    assert langid.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_language_does_not_depend_on_neighbours():
    texts = [t for _, t, _, _ in language_rows()[:40]]
    model = langid.Model(["a", "b"], np.ones(langid.BUCKETS), np.random.default_rng(0).normal(size=(langid.BUCKETS, 2)), np.zeros(2))
    together, alone = model.predict(texts)[1], [model.predict([t])[1][0] for t in texts]
    assert together.tolist() == alone


def plain_grams(text):
    """Bucket counts of a text's 1- to 3-grams, by whole numbers and one gram at a time."""
    low = f"  {text.lower()}  "
    codes = [32 if c in "\n\t\r" else ord(c) for c in low]
    out = Counter()
    for i in range(len(codes)):
        h = 0
        for k, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)):
            h = (h + (codes[i - k] if i >= k else 32) + k + 1) * factor % 2**32
            h ^= h >> 15
            out[(h * 0x27D4EB2F % 2**32) >> 17] += 1
    return out


def plain_ftrl(examples, languages):
    """FTRL-proximal with elastic net, one coordinate at a time."""
    z, n = ({(b, k): 0.0 for b in range(langid.BUCKETS + 1) for k in range(len(languages))} for _ in range(2))

    def weight(c):
        if abs(z[c]) <= langid.L1:
            return 0.0
        sign = 1 if z[c] > 0 else -1
        return -(z[c] - sign * langid.L1) / ((langid.BETA + n[c] ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(5)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(examples)):
            lang, x = examples[i]
            w = {(b, k): weight((b, k)) for b in x for k in range(len(languages))}
            score = [sum(v * w[b, k] for b, v in x.items()) for k in range(len(languages))]
            e = [np.exp(s - max(score)) for s in score]
            for k, name in enumerate(languages):
                gap = e[k] / sum(e) - (name == lang)
                for b, v in x.items():
                    g = gap * v
                    sigma = ((n[b, k] + g * g) ** 0.5 - n[b, k] ** 0.5) / langid.ALPHA
                    z[b, k] += g - sigma * w[b, k]
                    n[b, k] += g * g
    return weight


def test_language_model_equals_a_plain_one(spark):
    rows = language_rows()[:40]
    model = langid.fit(table(spark, rows))
    training = [(t, lang) for i, t, lang, _ in rows if zlib.crc32(str(i).encode()) % 5]
    seen = Counter(b for t, _ in training for b in plain_grams(t))
    idf = {b: np.log((1 + len(training)) / (1 + seen[b])) + 1 for b in range(langid.BUCKETS)}
    assert np.allclose(model.idf, [idf[b] for b in range(langid.BUCKETS)])

    def vector(t):
        x = {b: c * idf[b] for b, c in plain_grams(t).items()}
        return {b: v / sum(x.values()) for b, v in x.items()}

    texts = [t for _, t, _, _ in rows]
    plain = [[sum(v * model.weights[b, k] for b, v in vector(t).items()) + model.bias[k] for k in range(3)] for t in texts]
    buckets, starts, _ = langid.grams(texts)
    assert np.allclose(model.logits(buckets, starts), plain, rtol=1e-4, atol=1e-5)
    few = [(lang, vector(t)) for t, lang in training[:12]]
    names = sorted({lang for lang, _ in few})
    weights, bias = langid.follow_the_leader([(lang, 1, np.array(list(x), np.intp), np.array(list(x.values()))) for lang, x in few], names)
    weight = plain_ftrl([(lang, {**x, langid.BUCKETS: 0.05}) for lang, x in few], names)
    met = sorted({b for _, x in few for b in x})
    assert np.allclose(weights[met], [[weight((b, k)) for k in range(len(names))] for b in met])
    assert np.allclose(bias, [0.05 * weight((langid.BUCKETS, k)) for k in range(len(names))])


def test_one_hot_id(spark):
    """All rows under one id, many of them equal: the sample is bounded, counts equal rows once and is never empty."""
    texts = [(t, lang) for _, t, lang, _ in language_rows()[:60]]
    for i in (7, 8, 11, None):
        rows = [(i, t, lang, None) for t, lang in texts] + [(i, "ein sch ung der", "de", None)] * 3000
        model = langid.fit(table(spark, rows), 20)
        if i is None or zlib.crc32(str(i).encode()) % 5 == 0:
            assert model.languages == []
        else:
            assert model.languages == ["de", "en", "es"] and np.isfinite(model.temperature)
            assert langid.predict(table(spark, rows), model).where("lang_pred = lang_pred").count() == len(rows)


def test_unlikely_texts_are_rejected(spark):
    model = langid.fit(table(spark, language_rows()))
    assert (model.least > 1 / 4).all()
    doubtful = langid.Model(["a", "b", "c"], np.ones(langid.BUCKETS), np.zeros((langid.BUCKETS, 3)), np.zeros(3), 1.0, np.full(3, 0.4))
    assert doubtful.accepts(["any text", "12"]).tolist() == [False, False]
    assert model.accepts([t for _, t, _, _ in language_rows()]).mean() > 0.99


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, s) for i, t, lang, s in language_rows()]
    assert "zz" not in langid.fit(table(spark, rows)).languages


def brute_scores(docs, wanted):
    """(id, words, losses by target, background and whole corpus) by strings: each document is left out of the counts that score it."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [[w.translate(low) for w in words(t)] for _, t in docs]
    vocabulary = len({w for c in cut for w in c}) + 1
    mine = [i in wanted for i, _ in docs]
    sides = ([True], [False], [True, False])
    sizes = [sum(len(c) for c, m in zip(cut, mine, strict=True) if m in side) for side in sides]
    counts = []
    for side in sides:
        one, two = Counter(), Counter()
        for c, m in zip(cut, mine, strict=True):
            if m in side:
                one.update(c + [None] * bool(c))
                two.update(zip([None, *c], c, strict=False))
        counts.append((one, two))
    out = []
    for (i, _), c, m in zip(docs, cut, mine, strict=True):
        means = []
        for side, (one, two), n in zip(sides, counts, sizes, strict=True):
            s = sizes[0] / sizes[1] if side == [False] and all(sizes) else 1.0
            if m in side:
                one, two, n = one - Counter(c + [None] * bool(c)), two - Counter(zip([None, *c], c, strict=False)), n - len(c)
            loss = [-np.log((s * two[h, w] + 8 * (s * one[w] + 0.1) / (s * n + 0.1 * vocabulary)) / (s * one[h] + 8)) for h, w in zip([None, *c], c, strict=False)]
            means.append(np.mean(loss) if loss else None)
        out.append((i, len(c), *means))
    return out


def assert_scores(got, expected):
    key = lambda r: (str(r[0]), r[1], str(r[2])[:8], str(r[3])[:8])
    for r, e in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert (r.doc_id, r.n_tokens) == e[:2]
        if r.n_tokens:
            assert np.allclose([r.target_loss, r.background_loss, r.score, r.corpus_loss], [e[2], e[3], e[2] - e[3], e[4]], rtol=1e-9)
        else:
            assert r.target_loss is None and r.background_loss is None and r.score is None


def test_lm_scores(spark, awkward, nothing):
    docs = [(i, t) for i, t, _, _ in AWKWARD] + [(50 + i, f"good words here {i}") for i in range(5)]
    ids = spark.createDataFrame([(i,) for i in (50, 51, 51, 2, None)], "doc_id long")
    got = lm_scoring.score(table(spark, [(i, t, None, None) for i, t in docs]), ids).collect()
    assert_scores(got, brute_scores(docs, {50, 51, 2}))
    good = next(r.score for r in got if r.doc_id == 52)
    assert good < next(r.score for r in got if r.doc_id == 9)
    assert lm_scoring.score(nothing, ids).count() == 0


@pytest.mark.parametrize("wanted", [set(), {1, 2, 3}])
def test_lm_scores_with_one_side_only(spark, wanted):
    docs = [(1, "a b a"), (2, "b c"), (3, "c a b")]
    ids = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    assert_scores(lm_scoring.score(table(spark, [(i, t, None, None) for i, t in docs]), ids).collect(), brute_scores(docs, wanted))


def test_lm_counts_are_exact_over_chunks(spark, monkeypatch):
    """Many words, several chunks and ranges, ids that come by a shuffle; counted as strings by the brute force."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 3000)
    monkeypatch.setattr(lm_scoring, "RANGES", 7)
    monkeypatch.setattr(lm_scoring, "BROADCAST_IDS", 10)
    draw = random.Random(11)
    docs = [(i, " ".join([f"w{draw.randrange(i * 100, i * 100 + 1100)} common" for _ in range(200)])) for i in range(60)]
    docs = [(i, t + " " + " ".join(f"u{i}x{k}" for k in range(100))) for i, t in docs]
    wanted = set(range(0, 60, 3))
    ids = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    rows = table(spark, [(i, t, None, None) for i, t in docs]).repartition(3)
    assert_scores(lm_scoring.score(rows, ids).collect(), brute_scores(docs, wanted))


def test_a_repeated_document_stands_out(spark):
    """Left out of its own model, a text that occurs twice is still known from its other copy."""
    draw = random.Random(12)
    docs = [(i, " ".join(f"w{draw.randrange(400)}" for _ in range(80))) for i in range(100)]
    docs.append((100, docs[7][1]))
    got = {r.doc_id: r.corpus_loss for r in lm_scoring.score(table(spark, [(i, t, None, None) for i, t in docs]), spark.createDataFrame([(i,) for i in range(50, 70)], "doc_id long")).collect()}
    assert max(got[7], got[100]) + 0.5 < min(v for i, v in got.items() if i not in (7, 100))


def brute_top(vectors, k):
    usable = []
    for n, (i, v) in enumerate(vectors):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for n, i, v in usable:
        if i % 50 == 0:
            scores = ((sum(a * b for a, b in zip(v, w, strict=False)), j) for m, j, w in usable if m != n)
            best = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), j) for s, j in scores)[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("low", "high", "spread"), [(-1, 1, 1.0), (-1, 1, 0.0), (1e10, 1e12, 1.0)])
def test_top_k(spark, monkeypatch, low, high, spread):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 40)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 2)
    random_rows = np.random.default_rng(1)
    vectors = [(int(i), (random_rows.uniform(low, high, 8) * spread).astype(np.float32).tolist()) for i in random_rows.integers(0, 300, 150)]
    vectors += [(50, [0.5] * 8), (50, [0.5] * 8), (100, None), (150, [None] * 8), (200, [float("nan")] * 8), (250, [float("inf")] * 8), (7, [0.5] * 8)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("row", F.lit("x"))
    table_ = maxscore.integers(rows)
    got = maxscore.top_k(table_, table_.where("vec_id % 50 = 0"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(vectors, 5)


def test_top_k_small(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = maxscore.top_k(maxscore.integers(rows), maxscore.integers(rows), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 1, 65536 * 5), (1, 1, 0, 65536 * 5)]
    none = maxscore.integers(rows.where("false"))
    assert maxscore.top_k(none, none, 5).count() == 0


def test_pruning_skips_work():
    """MaxScore reads fewer values than a full scan where few dimensions matter."""
    random_rows = np.random.default_rng(2)
    values = np.floor(random_rows.normal(size=(4000, 32)) * 256 * np.geomspace(1, 0.001, 32))
    shard = maxscore.Shard(np.arange(4000), np.arange(4000), values)
    at, scores = shard.best(values[0], 0, 5)
    whole = values @ values[0]
    whole[0] = -np.inf
    assert sorted(scores.tolist(), reverse=True) == sorted(np.sort(whole)[-5:].astype(int).tolist(), reverse=True)


def test_pipeline_stages(spark, nothing):
    import corpus_pipeline

    rows = language_rows()[:120]
    rows += [(2000, rows[3][1], rows[3][2], "t"), (2001, rows[3][1] + " extra", rows[3][2], "t"), (2002, "1234 5678", "en", "t"), (2003, None, None, None), (2004, "der sch ung mail me@home.org ein", "de", None)]
    docs = table(spark, rows)
    seen = [docs]
    for _name, stage in corpus_pipeline.STAGES:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], "").collect(), stage(spark, seen[-1], "").schema))
    language, dedup, clean, mixed, encoded = seen[1:]
    assert all(s.columns == docs.columns for s in seen[1:-1])
    ids = lambda s: sorted(r.doc_id for r in s.select("doc_id").collect())
    assert ids(language) == sorted(r[0] for r in rows if r[0] not in (2002, 2003))
    groups = brute_groups([(r.doc_id, r.text) for r in language.collect()])
    assert ids(dedup) == sorted(d for d, _, c in groups if d == c)
    assert ids(clean) == ids(dedup)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[2004] == "der sch ung mail [EMAIL] ein" and text[0] == rows[0][1]
    total = lambda s: sum(len(words(r.text)) for r in s.collect())
    assert abs(total(mixed) - total(clean)) <= 3 and encoded.count() == mixed.count()
    for _name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0


def test_pipeline_runs_whole(spark, tmp_path):
    """run() over a table with copies, two sources and junk: words by brute force, tokens by the library."""
    import os

    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [(i, t, lang, "s" if i % 2 else "t") for i, t, lang, _ in language_rows()[:80]]
    rows += [(500 + i, t, lang, s) for i, t, lang, s in rows[:9]] + [(900, "!!", None, "t"), (901, None, None, None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    groups = {d for d, _, c in brute_groups([(i, t) for i, t, _, _ in rows[:89]]) if d == c}
    kept = {i: (t, s) for i, t, _, s in rows if i in groups}
    sizes = Counter()
    for t, s in kept.values():
        sizes[s] += len(words(t))
    wanted = {s: round(v) for s, v in brute_targets(sizes).items()}
    library, taken = Tokenizer.from_file(corpus_pipeline.tokenizer_path()), Counter()
    library.no_truncation()
    library.no_padding()
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text, source = kept[r.doc_id]
        full = library.encode(text, add_special_tokens=False).ids
        # A copy is whole, or the one at its source's cut: a beginning of whole words.
        cut = next(n for n in range(len(words(text)) + 1) if library.encode(" ".join(words(text)[:n]), add_special_tokens=False).ids == ids) if ids != full else len(words(text))
        taken[source] += cut
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert taken == Counter(wanted)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        assert all(os.listdir(os.path.join(folder.removeprefix("file://"), f)) == ["bpe"] for f in os.listdir(folder.removeprefix("file://")) if f.startswith("corpus-pipeline"))
