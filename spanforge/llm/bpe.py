"""BPE encoding and decoding with a contiguous rank array.

A word is a row of part ids beside a row of ranks, where the rank at i is that of merging parts i and i + 1.
Each round scans every row for its smallest rank (the leftmost on ties), deletes the boundary there, closes the
gap and refreshes the two neighbouring ranks. Rows of one length are handled together, so a scan is one numpy
call for thousands of words. Words above `SHORT` parts keep the same order of merges with a heap over linked
parts, because repeated scans would be quadratic there.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; strings of
special tokens inside a text become their ids, as the tokenizer file says; a null doc_id stays null; repeated rows
give repeated results; of equal ranks the leftmost merges first; a text of any length is encoded whole, a word of any
length in little more than linear time; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .arrow import ids_and_texts, map_steps

#: Parts up to which a word is a row of the rank array.
SHORT = 64
#: Different chunks of text whose ids a worker keeps before it starts anew.
CACHE = 400_000
#: Chunks of these characters (Latin letters, marks and signs) are cut by Python's `re`: here its classes, with the
#: numerals below, are the Unicode classes that the usual pattern names, composition changes nothing, and there is no
#: white space. U+0130 is left out: its lower case holds a combining mark.
LATIN = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]*")
NUMERAL = "\xb2\xb3\xb9\xbc-\xbe"
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_{NUMERAL}]+|[\d{NUMERAL}]|(?:[^\s\w]|_)+")
USUAL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if visible, else 256 and up."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b not in hidden else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """Tables of a tokenizer file of kind BPE with a word-end suffix and byte-level symbols.

    Built once on the driver and sent to workers; `Bpe.load(path)` reads the file.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], "<i4")
        self.last = np.array([vocab[s + suffix] for s in symbols], "<i4")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.split_pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._ready()

    def _ready(self) -> None:
        # The library's own classes cut and normalise, as its tables of Unicode are not those of Python's modules.
        self.split = pre_tokenizers.Split(Regex(self.split_pattern), "removed", invert=True)
        self.usual = self.split_pattern == USUAL_PATTERN and all("<" in s for s in self.special)
        cut = "|".join(re.escape(s) for s in self.special)
        self.cut_special = re.compile(f"({cut})") if cut else None
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.cache: dict[str, bytes] = {}
        self.rank: dict[int, int] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "cut_special", "normal", "cache", "rank")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging each pair, NO_RANK where there is none."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> list[np.ndarray]:
        """Ids of words that have equally many parts, one row each."""
        n, width = parts.shape
        ranks = np.full((n, width), NO_RANK, np.int32)
        if width > 1:
            ranks[:, :-1] = self.rank_of(parts[:, :-1], parts[:, 1:])
        size, where = np.full(n, width), np.arange(n)
        done: list[np.ndarray | None] = [None] * n
        columns = np.arange(width)
        while len(where):
            low = ranks.argmin(axis=1)
            best = ranks[np.arange(len(where)), low]
            over = best == NO_RANK
            if over.any():
                ended = np.flatnonzero(over)
                for at, row, k in zip(where[ended].tolist(), parts[ended], size[ended].tolist(), strict=True):
                    done[at] = row[:k]
                go = ~over
                parts, ranks, size, where, low, best = (x[go] for x in (parts, ranks, size, where, low, best))
                if not len(where):
                    break
            rows = np.arange(len(where))
            parts[rows, low] = self.merged[best]
            # Delete the boundary right of `low`: what stands behind it moves one place to the left.
            source = np.minimum(columns + (columns > low[:, None]), width - 1)
            parts = np.take_along_axis(parts, source, axis=1)
            source = np.minimum(columns + (columns >= low[:, None]), width - 1)
            ranks = np.take_along_axis(ranks, source, axis=1)
            size -= 1
            ranks[rows, size - 1] = NO_RANK
            for at in (low - 1, low):
                fresh = np.flatnonzero((at >= 0) & (at + 1 < size))
                a = at[fresh]
                ranks[fresh, a] = self.rank_of(parts[fresh, a], parts[fresh, a + 1])
        return done

    def merge_long(self, parts: np.ndarray) -> np.ndarray:
        """The same merges for one long word: a heap of (rank, place) over linked parts."""
        ids, n = parts.tolist(), len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        self.rank = self.rank or dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))  # once in a worker
        rank = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rank(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], "<i4")

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of different words, packed as little-endian 32-bit integers."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode("utf-8")
            by_width.setdefault(len(raw), []).append((word, raw))
        for width, group in by_width.items():
            raw = np.frombuffer(b"".join(r for _, r in group), np.uint8).reshape(len(group), width)
            parts = self.inner[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            rows = self.merge_rows(parts) if width <= SHORT else map(self.merge_long, parts)
            out.update((word, ids.tobytes()) for (word, _), ids in zip(group, rows, strict=True))
        return out

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of one chunk in order; a special token stands as its id."""
        if self.usual and chunk.isalpha() and LATIN.fullmatch(chunk):
            return [chunk.lower()]
        if self.usual and "<" not in chunk and LATIN.fullmatch(chunk):
            return LATIN_PIECES.findall(chunk.lower())
        found: list[str | int] = []
        for part in self.cut_special.split(chunk) if self.cut_special else [chunk]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                found += [w for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(part))]
        return found

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks into the cache."""
        cut = {c: self.pieces(c) for c in chunks}
        ids: dict = self.words(list({w for pieces in cut.values() for w in pieces if isinstance(w, str)}))
        ids |= {i: np.int32(i).tobytes() for i in self.special.values()}
        for chunk, pieces in cut.items():
            self.cache[chunk] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Only blank, line feed and tab cut chunks here: no word crosses white space, and
        the pattern skips all other kinds of it inside a chunk."""
        cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        fresh = set(chain.from_iterable(cut))
        if len(self.cache) > CACHE:
            self.cache.clear()
        fresh.difference_update(self.cache)
        self.learn(fresh)
        get = self.cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def decode(self, packed: bytes) -> str:
        """Tokens joined with blanks: the tokenizer file names no decoder."""
        shown = self.tokens
        return " ".join([shown[i] for i in np.frombuffer(packed, "<i4").tolist()])


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of whole texts: ids packed as little-endian unsigned 32-bit integers.

    `path`: a tokenizer file that the driver can read; its tables travel to the workers as a broadcast of fixed size.
    """
    tables = documents.sparkSession.sparkContext.broadcast(Bpe.load(path))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tables.value
        packed = bpe.encode([t or "" for t in batch.column(1).to_pylist()])
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        decoded = [bpe.decode(p) for p in packed]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts), pa.array(packed, pa.binary()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids", "decoded"],
        )

    return map_steps(ids_and_texts(documents), step, "doc_id long, n_tokens long, ids binary, decoded string")
