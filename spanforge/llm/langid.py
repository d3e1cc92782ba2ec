"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased characters, hashed to `BUCKETS`. A text's vector is its n-gram counts
times inverse document frequency, scaled to sum to one, so that a text of any length is one weighted mean of weights
and no n-gram has to be looked up twice. Document frequencies come from one pass over all training documents. Weights
are fitted with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded sample: for each language the `SAMPLE_PER_LANGUAGE` training
documents of smallest hash of id and text, equal rows counted once. A temperature is then fitted on a part of the sample
that the weights did not see, and the same part gives each language the least chance that a document of it may have.

Defined cases: a null text, or one without a letter, is `und` with score 0; a null lang trains nothing but is
predicted; texts of any length are used whole; without any training document (as in an empty table) everything with
letters is `und` with score 0; of equally likely languages the first by name is taken; rows with one doc_id, null ids
too, are rows of their own, learned from if their texts differ, and predicted each; of more than `LANGUAGES` values of
lang the commonest are learned; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_steps, steps
from .durable import durable

BUCKETS = 1 << 15
#: Parts of a vector of BUCKETS counts, which tasks add up side by side.
PARTS = 32
ORDERS = (1, 2, 3)
#: Documents for each language in the sample that weights and temperature are fitted on, and languages at most: the
#: bounds of what comes to the driver.
SAMPLE_PER_LANGUAGE, LANGUAGES = 600, 300
#: Share of the least own chance met in the temperature's part that a document must reach to be kept.
LEAST_SHARE = 0.5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 20.0, 1.0, 0.002, 0.0002
#: Bytes of text that are turned into n-grams at once; their arrays take about sixty times as much.
STEP_BYTES = 1 << 20
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNKNOWN = "und"


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, starts, letters): for each character its 1-, 2- and 3-gram ending there, as an array (characters, 3);
    where each text starts; whether each text has a letter. Two blanks around a text keep its neighbours out."""
    low = [f"  {t.lower()}  " if t else "    " for t in texts]
    joined = "".join(low)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0, *map(len, low)])
    white = (codes == 10) | (codes == 9) | (codes == 13)
    codes = np.where(white, np.uint32(32), codes)
    out = np.empty((len(codes), len(ORDERS)), np.uint16)
    rolled = np.zeros(len(codes), np.uint32)
    for k in range(len(ORDERS)):
        shifted = codes if not k else np.concatenate([np.full(k, 32, np.uint32), codes[:-k]])
        rolled = (rolled + shifted + np.uint32(k + 1)) * MULTIPLIERS[k]
        rolled ^= rolled >> np.uint32(15)
        out[:, k] = (rolled * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    letters = np.array([any(map(str.isalpha, t)) for t in low], bool)
    return out, starts, letters


@dataclass
class Model:
    """Weights (BUCKETS, languages), idf and temperature; of fixed size for a given set of languages."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: np.ndarray | None = None

    def logits(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        table = np.concatenate([self.weights * self.idf[:, None], self.idf[:, None]], axis=1).astype(np.float32)
        summed = np.zeros((len(starts) - 1, table.shape[1]))
        for k in range(buckets.shape[1]):
            summed += np.add.reduceat(table[buckets[:, k]], starts[:-1], axis=0, dtype=np.float64)
        return summed[:, :-1] / np.maximum(summed[:, -1:], 1e-12) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        buckets, starts, letters = grams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        chances = softmax(self.logits(buckets, starts) / self.temperature)
        best = chances.argmax(axis=1)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, chances[np.arange(len(best)), best], 0.0)

    def accepts(self, texts: list[str | None]) -> np.ndarray:
        """Whether a text has a letter and a language that is likely enough."""
        names, scores = self.predict(texts)
        least = dict(zip(self.languages, np.zeros(len(self.languages)) if self.least is None else self.least, strict=True))
        return np.array([n != UNKNOWN and s >= least[n] for n, s in zip(names, scores.tolist(), strict=True)], bool)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out() -> F.Column:
    """True for documents whose crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def packed(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts, decompressed_size=8 * BUCKETS // PARTS, codec="zstd", asbytes=True), "<i8")


def surveyed(training: DataFrame, per_language: int) -> tuple[np.ndarray, int, dict[str, int]]:
    """In how many training texts (lang, text, key) each bucket occurs, the number of texts, and for each language the
    largest key of its sample, the `per_language` smallest ones.

    A task gives one partial vector, in packed parts, and its smallest keys, so that the driver gets BUCKETS numbers and a
    key for each language whatever the input.
    """

    def count(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        smallest: dict[str, np.ndarray] = {}
        met: Counter[str] = Counter()
        for part in steps(batches, 1, STEP_BYTES):
            texts = part.column(1).to_pylist()
            buckets, starts, _ = grams(texts)
            n += len(texts)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                total[np.flatnonzero(np.bincount(buckets[a:b].ravel(), minlength=BUCKETS)) if b - a > 4000 else np.unique(buckets[a:b])] += 1
            langs, keys = np.array(part.column(0).to_pylist(), object), part.column(2).to_numpy()
            met.update(langs.tolist())
            for name in set(langs.tolist()):
                mine = np.concatenate([smallest.get(name, np.zeros(0, np.int64)), keys[langs == name]])
                smallest[name] = np.unique(mine)[:per_language]
        if n:
            rows = [(PARTS, None, n, None), *[(PARTS + 1, k, v, None) for k, v in met.items()]]
            rows += [(PARTS + 2, k, int(v), None) for k, vs in smallest.items() for v in vs]
            rows += [(k, None, None, packed(part)) for k, part in enumerate(np.split(total, PARTS)) if part.any()]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["part", "name", "n", "packed"])

    def added(rows: pa.Table) -> pa.Table:
        total = np.sum([unpacked(x) for x in rows.column("packed").to_pylist()], axis=0)
        return pa.table({"part": rows.column("part").slice(0, 1), "packed": pa.array([packed(total)], pa.binary())})

    found = durable(training.select("lang", "text", "key").mapInArrow(count, "part int, name string, n long, packed binary"))
    texts = found.where(f"part = {PARTS}").agg(F.sum("n")).first()[0]
    if not texts:
        return np.zeros(BUCKETS, np.int64), 0, {}
    seen = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    for r in found.where(f"part < {PARTS}").groupBy("part").applyInArrow(added, "part int, packed binary").collect():
        seen[r.part] = unpacked(r.packed)
    common = found.where(f"part = {PARTS + 1}").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(LANGUAGES).select("name")
    place = F.row_number().over(Window.partitionBy("name").orderBy("n"))
    keys = found.where(f"part = {PARTS + 2}").join(F.broadcast(common), "name").select("name", "n").distinct().withColumn("place", place).where(F.col("place") <= per_language)
    last = keys.groupBy("name").agg(F.max("n").alias("n"))
    return seen.ravel(), texts, {r["name"]: r["n"] for r in last.collect()}


def vectors(sample: DataFrame, idf: np.ndarray) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(lang, part, buckets, values) of each sampled document (lang, text, part, key), in the order of keys; part 0 is kept
    for the temperature."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets, starts, _ = grams(batch.column(1).to_pylist())
        places, values = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            which, counts = np.unique(buckets[a:b], return_counts=True)
            x = counts * idf[which]
            places.append(which.astype(np.int32))
            values.append((x / max(x.sum(), 1e-12)).astype(np.float32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "part", "key", "at", "x"])

    rows = map_steps(sample, step, "lang string, part int, key long, at array<int>, x array<float>", most=STEP_BYTES).toPandas()
    return [(r.lang, r.part, np.asarray(r.at, np.intp), np.asarray(r.x, np.float64)) for r in rows.sort_values(["lang", "key"]).itertuples(index=False)]


def follow_the_leader(examples: list, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after EPOCHS passes of FTRL-proximal with elastic-net penalties, in a fixed shuffled order."""
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    number = {name: i for i, name in enumerate(languages)}

    def solve(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    random = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in random.permutation(len(examples)):
            lang, _, at, x = examples[i]
            at, x = np.append(at, BUCKETS), np.append(x, 0.05)
            w = solve(z[at], n[at])
            scores = x @ w
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[number[lang]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(z, n)
    return w[:-1], w[-1] * 0.05


def fit(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the documents (text, lang, doc_id) that are not held out."""
    training = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    training = training.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("key"))
    seen, n, last = surveyed(training, per_language)
    languages = sorted(last)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    idf = np.log((1 + n) / (1 + seen)) + 1
    bound = F.element_at(F.create_map(*[F.lit(x) for item in last.items() for x in item]), F.col("lang"))
    chosen = training.where(F.col("key") <= bound).dropDuplicates(["lang", "key"])
    examples = vectors(chosen.select("lang", "text", F.pmod(F.xxhash64("key"), F.lit(5)).cast("int").alias("part"), "key"), idf)
    fitted, kept = [e for e in examples if e[1]] or examples, [e for e in examples if not e[1]] or examples
    weights, bias = follow_the_leader(fitted, languages)
    scores = np.array([x @ weights[at] + bias for _, _, at, x in kept])
    truth = np.array([languages.index(e[0]) for e in kept])
    # Platt's smoothed targets: without them the temperature of a separable sample would go to zero.
    doubt = 1 / (len(truth) + 2)

    def loss(t: float) -> float:
        logs = np.log(np.maximum(softmax(scores / t), 1e-12))
        own = logs[np.arange(len(truth)), truth]
        return -((1 - doubt) * own + doubt * (logs.sum(axis=1) - own)).mean()

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    chances = softmax(scores / temperature)[np.arange(len(truth)), truth]
    least = np.array([LEAST_SHARE * min(chances[truth == k], default=0.0) for k in range(len(languages))])
    return Model(languages, idf, weights, bias, float(temperature), least)


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) from texts alone; held_out only says which rows were not learned from."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = sent.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return map_steps(rows, step, "doc_id long, held_out boolean, lang_pred string, score double", most=STEP_BYTES)


def filter_documents(documents: DataFrame, model: Model) -> DataFrame:
    """documents, all columns, without those that have no letter, or whose likeliest language is less likely than
    LEAST_SHARE of the least that its known documents have."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(sent.value.accepts(batch.column(place).to_pylist())))

    return map_steps(documents, step, documents.schema, place, STEP_BYTES)
