"""Cross-entropy difference of documents under a target and a background n-gram model.

The two models are matched: one vocabulary (all words of the corpus), one order (bigrams over unigrams), one smoothing,
and one size: the background is the corpus without the target, and its counts are scaled so that both count as many
words. What a document itself adds is taken off before it is scored, so that a target document is not known by heart
while others are strange. Every document is counted; only what both corpora hold makes the difference.

For a word w after h (the text's start counts as a word), with counts c, size N and V distinct words:

    p(w) = (s c(w) + ADDED) / (s N + ADDED (V + 1)),   p(w | h) = (s c(h, w) + BACKOFF p(w)) / (s c(h) + BACKOFF)

where s is 1 for the target and target words / background words for the background. c(h) counts all places of h, also
those at a text's end, so the rest of its chance belongs to the end. A document's score is the mean over its words of
target loss minus background loss, in nats; low means like the target. A third loss, by the same model of the whole
corpus (s = 1), says how well all other documents know this one; it is low for what is repeated.

Words and pairs are known by 64-bit hashes and counted one by one; no table is bounded and none comes to the driver:

1. A map pass packs the documents into chunks of some `CHUNK` tokens, each a list of distinct words, the commonest first,
   and places in that list. Chunks go to the checkpoint folder.
2. Each chunk's distinct words and pairs, with their counts there, are dealt out by ranges of the hash. A hot key is one
   entry of a chunk, and the number of ranges grows with the text, so that a range stays of bounded size.
3. Each range adds up its keys over all chunks and answers every chunk with the sums, in the order of the chunk's keys.
4. A chunk meets its answers and scores its documents.

Defined cases: a null or blank text has no tokens, and null losses and score; a null doc_id is no target; rows with one
doc_id are scored each, and are all targets if the id is one; without target (or other) documents that model is uniform;
a text of any length is one document of one chunk; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ids_and_texts, steps, text_bytes
from .durable import durable
from .shingles import FIRST, SECOND, mix, word_hashes

#: Added to each word's count, and the weight of the unigram in a bigram's estimate.
ADDED, BACKOFF = 0.1, 8.0
#: The history at a text's start.
START = np.uint64(0)
#: Tokens of a chunk, the least number of key ranges, and the bytes of all texts for each range.
CHUNK, RANGES, RANGE_BYTES = 3 << 19, 512, 16 << 20
#: Target ids that may be broadcast (some 40 bytes each); more of them meet the texts in a shuffle.
BROADCAST_IDS = 500_000

PACKED = "chunk long, part long, keys binary, target binary, every binary, met long"
SIZES = ("target_words", "every_word", "target_texts", "every_text")
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double, corpus_loss double"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, bytes of one weight side by side, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    planes = values.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    planes = pa.decompress(packed[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def joined(arrays: list[np.ndarray]) -> bytes:
    parts = [pack(a) for a in arrays]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(packed: bytes) -> list[np.ndarray]:
    found = []
    while packed:
        end = 8 + int.from_bytes(packed[:8], "little")
        found.append(unpack(packed[8:end]))
        packed = packed[end:]
    return found


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["chunk", "part", "keys", "target", "every", "met"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


class Chunk:
    """Documents as places in a list of distinct words: number of words, id, id known, target, for each document."""

    def __init__(self, n, ids, known, wanted, words, code):
        self.n, self.ids, self.known, self.wanted = n.astype(np.int64), ids, known > 0, wanted > 0
        self.words, self.code = words, code.astype(np.intp)
        self.before = np.concatenate([[0], np.cumsum(self.n)])
        self.owner = np.repeat(np.arange(len(n)), self.n)

    def pairs(self) -> np.ndarray:
        """A hash of each word and the one before it."""
        history = np.empty(len(self.code), np.uint64)
        word = self.words[self.code]
        history[1:] = word[:-1]
        history[self.before[:-1][self.n > 0]] = START
        return mix(history * FIRST + (word ^ SECOND) * SECOND)


def chunks(flagged: DataFrame) -> DataFrame:
    """One row per chunk of all documents (doc_id, text, is_target): words and texts with words, of the target and in all."""

    def run(batches):
        at, held, size = 0, [], 0

        def whole():
            ids = pa.concat_arrays([h[0] for h in held])
            wanted, word, n = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            words, code, counts = np.unique(word, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            known = np.asarray(ids.is_valid())
            documents = joined([n, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), known, wanted, words[order], place[code]])
            seed = f"{TaskContext.get().partitionId()} {at}".encode()
            name = int.from_bytes(hashlib.blake2b(seed + documents, digest_size=8).digest(), "little", signed=True)
            sizes = [n[wanted].sum(), n.sum(), (n[wanted] > 0).sum(), (n > 0).sum()]
            columns = [pa.array([name], pa.int64()), pa.array([documents], pa.binary()), *[pa.array([int(x)], pa.int64()) for x in sizes]]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "documents", *SIZES])

        for part in steps(batches):
            word, before = word_hashes(*text_bytes(part.column(1)))
            held.append((part.column(0), np.asarray(part.column(2).to_pylist(), bool), word, np.diff(before)))
            size += len(word) + part.num_rows
            if size >= CHUNK:
                yield whole()
                at, held, size = at + 1, [], 0
        if held:
            yield whole()

    return flagged.select("doc_id", "text", "is_target").mapInArrow(run, "chunk long, documents binary, " + ", ".join(f"{name} long" for name in SIZES))


def keys(held: DataFrame, ranges: int) -> DataFrame:
    """PACKED rows: each chunk's distinct words (parts from 0) and pairs (parts from `ranges`) with their counts."""

    def run(batches):
        for batch in batches:
            for name, documents in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chunk = Chunk(*parted(documents))
                wanted, rows = chunk.wanted[chunk.owner], []
                for kind, values in enumerate((chunk.words[chunk.code], chunk.pairs())):
                    distinct, which = np.unique(values, return_inverse=True)
                    every = np.bincount(which, minlength=len(distinct))
                    target = np.bincount(which[wanted], minlength=len(distinct))
                    part = ((distinct >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                    cuts = [*np.flatnonzero(np.diff(part, prepend=np.uint64(ranges))).tolist(), len(distinct)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        gaps = np.diff(distinct[a:b], prepend=np.uint64(0))
                        rows.append((name, kind * ranges + int(part[a]), pack(gaps), pack(target[a:b]), pack(every[a:b]), 0))
                yield packed_rows(rows)

    return held.select("chunk", "documents").mapInArrow(run, PACKED)


def summed(packed: DataFrame, ranges: int) -> DataFrame:
    """PACKED rows with the sums over all chunks in place of a chunk's own counts, and without keys. met: in the first
    row of a range of words, the number of distinct ones."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        mine = [np.cumsum(unpack(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        distinct, which = np.unique(np.concatenate(mine), return_inverse=True)
        sums = []
        for name in ("target", "every"):
            counts = np.concatenate([unpack(v) for v in table.column(name).to_pylist()])
            sums.append(np.bincount(which, counts, len(distinct)).astype(np.uint64))
        ends = np.cumsum([0, *map(len, mine)])
        rows = []
        for row, chunk in enumerate(table.column("chunk").to_pylist()):
            here = which[ends[row] : ends[row + 1]]
            rows.append((chunk, part, None, pack(sums[0][here]), pack(sums[1][here]), len(distinct) if part < ranges and not row else 0))
        return pa.Table.from_batches([packed_rows(rows)])

    return packed.groupBy("part").applyInArrow(run, PACKED)


def scored(held: DataFrame, answers: DataFrame, ranges: int) -> DataFrame:
    """SCORED rows of the documents in `held` (chunks) by `answers` (PACKED, summed)."""
    vocabulary = answers.agg(F.sum("met").alias("met")).first().met or 0
    total = held.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in SIZES]).first()
    # Of the three models: target, background, whole corpus.
    size = (total.target_words, total.every_word - total.target_words, total.every_word)
    texts = (total.target_texts, total.every_text - total.target_texts, total.every_text)
    scales = (1.0, size[0] / size[1] if size[0] and size[1] else 1.0, 1.0)

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        order = np.argsort(parts)  # the documents' part is -1
        chunk = Chunk(*parted(table.column("keys")[int(order[0])].as_py()))
        order = order[1:]
        own, sums = [], []
        for kind, values in enumerate((chunk.words[chunk.code], chunk.pairs())):
            distinct, which = np.unique(values, return_inverse=True)
            here = [int(i) for i in order if parts[i] // ranges == kind]
            counts = [np.concatenate([np.zeros(0, np.uint64), *[unpack(table.column(c)[i].as_py()) for i in here]]).astype(np.float64) for c in ("target", "every")]
            if any(len(c) != len(distinct) for c in counts):
                raise ValueError("a chunk lacks counts of its words")
            # How often each word or pair stands in the document that holds this place.
            again, back = np.unique(chunk.owner * len(distinct) + which, return_inverse=True)
            own.append(np.bincount(back, minlength=len(again))[back])
            sums.append((counts[0][which], (counts[1] - counts[0])[which], counts[1][which]))
        first = np.zeros(len(chunk.code), bool)
        first[chunk.before[:-1][chunk.n > 0]] = True
        some, means = chunk.n > 0, []
        for side, s, mine in zip((0, 1, 2), scales, (chunk.wanted, ~chunk.wanted, np.ones(len(chunk.n), bool)), strict=True):
            left = mine[chunk.owner]
            word = s * (sums[0][side] - left * own[0])
            pair = s * (sums[1][side] - left * own[1])
            # At a text's start the history is the start of all other documents with words.
            starts = s * (texts[side] - mine)[chunk.owner]
            history = np.where(first, starts, np.concatenate([[0.0], word[:-1]]) if len(word) else word)
            whole = s * (size[side] - np.where(mine, chunk.n, 0))[chunk.owner]
            one = (word + ADDED) / (whole + ADDED * (vocabulary + 1))
            loss = -np.log((pair + BACKOFF * one) / (history + BACKOFF))
            mean = np.full(len(chunk.n), np.nan)
            if some.any():
                mean[some] = np.add.reduceat(loss, chunk.before[:-1][some]) / chunk.n[some]
            means.append(mean)
        ids = pa.array(chunk.ids.view(np.int64), mask=~chunk.known)
        columns = [pa.array(c, mask=~some) for c in (*means[:2], means[0] - means[1], means[2])]
        return pa.table([ids, pa.array(chunk.n), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score", "corpus_loss"])

    documents = held.select("chunk", F.lit(-1).cast("long").alias("part"), F.col("documents").alias("keys"), F.lit(None).cast("binary").alias("target"), F.lit(None).cast("binary").alias("every"), F.lit(0).cast("long").alias("met"))
    return documents.unionByName(answers).groupBy("chunk").applyInArrow(run, SCORED)


def score(documents: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score, corpus_loss); target_ids: (doc_id) of the target corpus."""
    rows = ids_and_texts(documents)
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    few = wanted.count() <= BROADCAST_IDS
    flagged = rows.join(wanted.hint("broadcast" if few else "merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("is_target", F.lit(False)).alias("is_target"))
    ranges = max(RANGES, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    held = durable(chunks(flagged))
    return scored(held, durable(summed(keys(held, ranges), ranges)), ranges)


ORACLE = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id IS NOT NULL), false) AS mine,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
tokens AS (SELECT r, mine, len(w) AS n, unnest(w) AS word, unnest(list_prepend(CAST(NULL AS VARCHAR), w[:-2])) AS history FROM docs WHERE len(w) > 0),
words AS (SELECT word, count(*) FILTER (mine) AS t, count(*) AS a FROM tokens GROUP BY word),
pairs AS (SELECT history, word, count(*) FILTER (mine) AS t, count(*) AS a FROM tokens GROUP BY history, word),
own_words AS (SELECT r, word, count(*) AS c FROM tokens GROUP BY r, word),
own_pairs AS (SELECT r, history, word, count(*) AS c FROM tokens GROUP BY r, history, word),
sizes AS (
  SELECT CAST(count(*) FILTER (mine) AS DOUBLE) AS nt, CAST(count(*) AS DOUBLE) AS na, count(DISTINCT word) + 1 AS v,
         count(*) FILTER (mine AND history IS NULL) AS st, count(*) FILTER (history IS NULL) AS sa FROM tokens),
sides AS (
  SELECT 't' AS side, 1.0 AS s, nt AS size, st AS starts, v, 1 AS t, 0 AS a FROM sizes
  UNION ALL SELECT 'b', CASE WHEN nt > 0 AND na > nt THEN nt / (na - nt) ELSE 1.0 END, na - nt, sa - st, v, -1, 1 FROM sizes
  UNION ALL SELECT 'a', 1.0, na, sa, v, 0, 1 FROM sizes),
counted AS (
  SELECT k.r, side, s, v, CASE WHEN side = 'a' OR (side = 't') = k.mine THEN 1 ELSE 0 END AS own,
         size - own * k.n AS size, sides.t * words.t + sides.a * words.a - own * ow.c AS c1, sides.t * pairs.t + sides.a * pairs.a - own * op.c AS c2,
         CASE WHEN k.history IS NULL THEN starts - own ELSE sides.t * hw.t + sides.a * hw.a - own * oh.c END AS ch
  FROM tokens AS k CROSS JOIN sides
  JOIN words ON words.word = k.word
  JOIN pairs ON pairs.word = k.word AND pairs.history IS NOT DISTINCT FROM k.history
  JOIN own_words AS ow ON ow.r = k.r AND ow.word = k.word
  JOIN own_pairs AS op ON op.r = k.r AND op.word = k.word AND op.history IS NOT DISTINCT FROM k.history
  LEFT JOIN words AS hw ON hw.word = k.history
  LEFT JOIN own_words AS oh ON oh.r = k.r AND oh.word = k.history),
losses AS (
  SELECT r, side, avg(-ln((s * c2 + {BACKOFF} * (s * c1 + {ADDED}) / (s * size + {ADDED} * v)) / (s * ch + {BACKOFF}))) AS loss FROM counted GROUP BY r, side)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(t.loss, 6) AS target_loss, round(b.loss, 6) AS background_loss, round(t.loss - b.loss, 6) AS score, round(a.loss, 6) AS corpus_loss
FROM docs LEFT JOIN losses AS t ON t.r = docs.r AND t.side = 't' LEFT JOIN losses AS b ON b.r = docs.r AND b.side = 'b' LEFT JOIN losses AS a ON a.r = docs.r AND a.side = 'a'
"""
