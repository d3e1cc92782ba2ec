"""Secrets: exact base patterns plus a character convolutional network over every further candidate.

Candidates are all runs of key-like characters, `LEAST` or more, that hold a digit or change case inside, and that touch
no base span. The network in numpy (character embeddings, one convolution, maximum over the candidate and over its
context, a logistic layer) reads the whole candidate, however long, in overlapping pieces, and the characters around
it. It is trained here by Adam on labelled findings that `findings` makes from rules, its scores are calibrated by
Platt's method on a held-out part, and the threshold is the highest at which held-out recall is at least `RECALL`.
Candidates above it become spans: of kind hex if they are hexadecimal, access if they begin like an access key,
otherwise assign.

Defined cases: a null text counts as empty and has no spans; a null doc_id stays null; rows with one doc_id, and equal
rows, are each scanned; of spans with one start the kind listed first comes first; other columns are ignored; texts of
any length are scanned whole, in linear time; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import ids_and_texts, map_steps

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run that is too short stays so when begun later, hence only whole runs are tried.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
#: The least length of a candidate.
LEAST = 8
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+")
TELLING = re.compile("[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]")
#: Characters of context on each side, and of a candidate's piece; neighbouring pieces share what a convolution spans.
CONTEXT, PIECE = 24, 48
WIDTH = 2 * CONTEXT + PIECE
EMBED, FILTERS, SPAN = 8, 24, 5
#: Least share of held-out findings above the threshold.
RECALL = 0.95
ALPHABET = 128


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order of start, then kind."""
    found = []
    if ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets and that no base span touches."""
    starts = [[s for s, k, _ in base if k == kind] for kind in range(len(KINDS))]
    ends = [[e for _, k, e in base if k == kind] for kind in range(len(KINDS))]
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if TELLING.search(m[0]) and not any(bisect_left(s, end) > bisect_right(e, start) for s, e in zip(starts, ends, strict=True) if s):
            found.append((start, end))
    return found


def windows(text: str, start: int, end: int) -> list[str]:
    """Pieces of the candidate, the whole of it together, each between its context: WIDTH characters, filled with NUL."""
    left = text[max(0, start - CONTEXT) : start].rjust(CONTEXT, "\0")
    right = text[end : end + CONTEXT].ljust(CONTEXT, "\0")
    step = PIECE - SPAN + 1
    return [left + text[at : min(end, at + PIECE)].ljust(PIECE, "\0") + right for at in range(start, max(start + 1, end - SPAN + 1), step)]


def coded(pieces: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "replace"), np.uint32).reshape(-1, WIDTH)
    return np.where(codes < ALPHABET, codes, 1).astype(np.intp)


class Network:
    """Embedding, convolution, rectifier, maximum over the candidate and over the context, logistic layer."""

    def __init__(self, seed: int = 1):
        random = np.random.default_rng(seed)
        self.p = {
            "embed": random.normal(0, 0.3, (ALPHABET, EMBED)),
            "conv": random.normal(0, (2 / (SPAN * EMBED)) ** 0.5, (SPAN * EMBED, FILTERS)),
            "conv0": np.zeros(FILTERS),
            "out": random.normal(0, 0.2, 2 * FILTERS),
            "out0": np.zeros(1),
        }
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def pooled(self, codes: np.ndarray):
        """The filters' maxima over each piece and over its context, and what they come from."""
        n, places = len(codes), WIDTH - SPAN + 1
        e = self.p["embed"][codes]
        columns = np.lib.stride_tricks.sliding_window_view(e, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n * places, SPAN * EMBED)
        a = (columns @ self.p["conv"] + self.p["conv0"]).reshape(n, places, FILTERS)
        inside = np.zeros(places, bool)
        inside[CONTEXT - SPAN // 2 : CONTEXT + PIECE - SPAN // 2] = True
        tops = [np.where(part[:, None], a, -np.inf).argmax(axis=1) for part in (inside, ~inside)]
        return np.concatenate([np.take_along_axis(a, t[:, None, :], 1)[:, 0] for t in tops], axis=1), (columns, tops, places)

    def scores(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled, 0)
        return hidden @ self.p["out"] + self.p["out0"], hidden

    def forward(self, codes: np.ndarray) -> np.ndarray:
        """Scores of candidates of one piece each."""
        return self.scores(self.pooled(codes)[0])[0]

    def gradients(self, codes: np.ndarray, truth: np.ndarray) -> dict[str, np.ndarray]:
        pooled, (columns, tops, places) = self.pooled(codes)
        z, hidden = self.scores(pooled)
        n = len(codes)
        d = (1 / (1 + np.exp(-z)) - truth) / n
        dh = d[:, None] * self.p["out"] * (pooled > 0)
        rows = np.concatenate([(np.arange(n)[:, None] * places + t).ravel() for t in tops])
        filters = np.tile(np.arange(FILTERS), 2 * n)
        values = np.concatenate([dh[:, :FILTERS].ravel(), dh[:, FILTERS:].ravel()])
        conv = np.zeros_like(self.p["conv"])
        np.add.at(conv.T, filters, values[:, None] * columns[rows])
        back = values[:, None] * self.p["conv"].T[filters]
        chars = codes[rows // places][np.arange(len(rows))[:, None], (rows % places)[:, None] + np.arange(SPAN)]
        embed = np.zeros_like(self.p["embed"])
        np.add.at(embed, chars.ravel(), back.reshape(-1, EMBED))
        return {"embed": embed, "conv": conv, "conv0": np.bincount(filters, values, FILTERS), "out": hidden.T @ d, "out0": d.sum(keepdims=True)}

    def train(self, codes: np.ndarray, truth: np.ndarray, epochs: int = 8, size: int = 64, rate: float = 0.004) -> None:
        random, step = np.random.default_rng(2), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = random.permutation(len(codes))
            for i in range(0, len(order), size):
                step += 1
                for k, g in self.gradients(codes[order[i : i + size]], truth[order[i : i + size]]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, codes: np.ndarray, truth: np.ndarray) -> None:
        """Platt's sigmoid by Newton steps on held-out scores, then the threshold that keeps RECALL of the findings."""
        z = self.forward(codes)
        positive, negative = truth.sum(), len(truth) - truth.sum()
        wanted = np.where(truth > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
        x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - wanted) + 1e-3 * (w - [1, 0]))
        self.slope, self.shift = w
        chances = np.sort(self.chances(codes, np.arange(len(codes)))[truth > 0])
        self.threshold = float(chances[int(np.floor((1 - RECALL) * len(chances)))]) if len(chances) else 0.5

    def chances(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Calibrated chances of candidates; first: where the pieces of each begin."""
        if not len(first):
            return np.zeros(0)
        pooled = np.concatenate([self.pooled(codes[i : i + 256])[0] for i in range(0, len(codes), 256)])
        z = self.scores(np.maximum.reduceat(pooled, first, axis=0))[0]
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def findings(count: int = 3000, seed: int = 4) -> tuple[list[str], np.ndarray]:
    """First windows of labelled findings made from rules: keys and passwords in settings, headers and addresses against
    names, versions, numbers, links, digests in prose, identifiers and long words."""
    random = np.random.default_rng(seed)
    upper, lower, number = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, n: "".join(random.choice(list(chars), n))
    size = lambda a, b: int(random.integers(a, b))
    word = lambda: some("aeinorst" + lower, size(2, 10))
    prose = lambda n: getattr(" ".join(word() for _ in range(n)), ["lower", "lower", "title", "upper"][size(0, 4)])()
    texts, truth = [], []
    for i in range(count):
        if i % 2:
            key = [lambda: some(upper + lower + number, size(20, 48)), lambda: some(upper + lower + number + "+/", size(28, 64)) + "=", lambda: f"ghp_{some(upper + lower + number, 36)}", lambda: f"sk-{some(upper + lower + number, size(24, 48))}", lambda: f"xoxb-{some(number, 12)}-{some(upper + lower + number, 24)}", lambda: some(upper + number, 20), lambda: some("abcdef" + number, size(20, 32))][size(0, 7)]()
            lead = ["pwd=", "auth: ", "Authorization: Bearer ", "access_key = ", "private-key: ", 'credential="', "client_key='", "passphrase: ", "signing_key=", "key=", "AWS_KEY="][size(0, 11)]
            text, start = f"{prose(size(0, 6))} {lead}", 0
        else:
            lead = ["", "", "the ", "see ", "version ", "id ", "order ", "file ", "https://", "www."][size(0, 10)]
            key = [lambda: "-".join(word() for _ in range(size(3, 6))) + str(size(1, 99)), lambda: f"{word()}_{word()}_{word()}{size(1, 2000)}", lambda: f"{word()}/{word()}/{word()}{size(1, 99)}", lambda: f"20{some(number, 2)}-{some(number, 2)}-{some(number, 2)}T{some(number, 2)}", lambda: f"{word()}{word()}{word()}{size(0, 99)}", lambda: word().capitalize() + word().capitalize() + word().capitalize() + word().capitalize() + "Handler", lambda: f"{some(number, 8)}-{some(number, 4)}-{some(number, 4)}a", lambda: "=" * 10 + word() + "2" + "=" * 10, lambda: f"{word()}-{some(number, 12)}", lambda: some(number, size(8, 24)), lambda: some(number, 16), lambda: f"{some(number, 3)}-{some(number, 4)}", lambda: f"{word()}{size(1, 999)}", lambda: f"{some('abcdef' + number, 8)}-{some('abcdef' + number, 4)}-{some('abcdef' + number, 4)}-{some('abcdef' + number, 4)}-{some('abcdef' + number, 12)}"][size(0, 14)]()
            text = f"{prose(size(0, 6))} {lead}"
        start = len(text)
        text += key
        end = len(text)
        text += ["", '"', "'", "\n", ".", ";", "###", "%%%", "!!", "***"][size(0, 10)] + " " + prose(size(0, 6))
        texts.append(windows(text, start, end)[0])
        truth.append(i % 2)
    return texts, np.array(truth, float)


@lru_cache(maxsize=1)
def train() -> Network:
    pieces, truth = findings()
    codes = coded(pieces)
    kept = np.arange(len(pieces)) // 2 % 4 == 0
    network = Network()
    network.train(codes[~kept], truth[~kept])
    network.calibrate(codes[kept], truth[kept])
    return network


def kind_of(word: str) -> int:
    return 1 if word.startswith("AKIA") else 2 if all(c in "0123456789abcdef" for c in word) else 0


def find(texts: list[str], network: Network) -> tuple[list, list]:
    """Base spans and all spans of each text, as sorted (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    spans = [(i, *c) for i, t in enumerate(texts) for c in candidates(t, base[i])]
    full = [list(b) for b in base]
    if spans:
        pieces = [windows(texts[i], s, e) for i, s, e in spans]
        chances = network.chances(coded([w for row in pieces for w in row]), np.cumsum([0, *map(len, pieces)])[:-1])
        for j in np.flatnonzero(chances >= network.threshold).tolist():
            i, start, end = spans[j]
            full[i].append((start, kind_of(texts[i][start:end]), end))
    return base, [sorted(f) for f in full]


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive."""
    sent = documents.sparkSession.sparkContext.broadcast(train())
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = find([t or "" for t in batch.column(1).to_pylist()], sent.value)
        columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found], pa.list_(span)) for found in both]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_steps(ids_and_texts(documents), step, f"doc_id long, base {kind}, spans {kind}")
