"""Personal data: exact base patterns plus a skip-chain conditional random field.

Base spans come from four patterns with checks (e-mail, IP, card, phone). The field then labels tokens: every token that
holds a digit or an at sign, with the `AROUND` words on either side of it. A label is a kind of personal data (the four,
and access keys), or the kind that a word leads in ("call", "token ="), or none. Neighbouring tokens share a chain
potential; distant tokens that are equal, or similar (the same letters and digits, the same number behind another
prefix, the same mailbox), share a skip potential between successive occurrences, so that a label found in one place
carries to the others. Sum-product messages pass over this loopy graph, damped, for many documents at once; a token
whose kind is nearly certain becomes a span, if it overlaps no base span. The weights are trained here, by gradient
ascent on the same messages' expectations, on labelled texts that `examples` makes from rules.

Defined cases: a null text counts as empty and has no spans; a null doc_id stays null; rows with one doc_id, and equal
rows, are each scanned; of spans with one start the kind listed first comes first; other columns are ignored by `scan`
and kept by `redact`; a text of any length is one graph, linear in its tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ids_and_texts, map_steps

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: those with a base pattern, and what only the field finds.
SPAN_KINDS = (*KINDS, "key")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failing start inside a run of digits fails for the run's first digit too, so only that one is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
SEED = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
#: A token: a run without white space, quotes and equals signs, or an equals sign.
TOKEN = re.compile(r"""[^\x20\x09-\x0D"'=]+|=""")
WHITE = frozenset(" \t\n\v\f\r")
#: Words on either side of a token with a digit or an at sign that stand in the chain.
AROUND = 3
#: A label's least probability for a new span, and the number and damping of message rounds.
CERTAIN, ROUNDS, DAMP = 0.9, 8, 0.3
#: Tokens of all documents that are put into one graph; a document is never divided.
GRAPH = 50_000
#: Words that lead in each kind, and at last such as lead in numbers and digests that are no personal data.
CUES = (
    ("email", "e-mail", "mail", "mailto", "contact", "correo", "courriel"),
    ("ip", "host", "server", "address", "gateway"),
    ("card", "visa", "mastercard", "amex", "credit", "karte", "tarjeta", "carte"),
    ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "telefono"),
    ("token", "password", "passwd", "pwd", "secret", "key", "apikey", "api_key", "access_key", "credential", "bearer", "passphrase"),
    ("sha1", "sha256", "md5", "commit", "checksum", "digest", "hash", "uuid", "id", "version", "order", "serial", "isbn"),
)
LEADS = {word: kind for kind, words in enumerate(CUES) for word in words}
#: None, the kinds, the words that lead in a kind or something else.
LABELS = 1 + len(SPAN_KINDS) + len(CUES)
FIRST_LEAD = 1 + len(SPAN_KINDS)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        end = at
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            found.append((start, end))
        last = max(end, at + 1)
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, in order of start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The token without punctuation around it, or whole if there is nothing else."""
    first, last = start, end
    while first < last and not (text[first].isalnum() or text[first] in "+(@"):
        first += 1
    while last > first and not (text[last - 1].isalnum() or text[last - 1] in ")@"):
        last -= 1
    return (first, last) if first < last else (start, end)


def tokens(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, next): tokens with a digit or an at sign and the words around them; next: it stands beside the token
    before it."""
    found: list[tuple[int, int, bool]] = []
    done = 0
    for m in SEED.finditer(text):
        if m.end() <= done:
            continue
        start = m.start()
        for step in range(AROUND + 1):
            while step and start > done and text[start - 1] in WHITE:
                start -= 1
            while start > done and text[start - 1] not in WHITE:
                start -= 1
        here = [x.span() for x in TOKEN.finditer(text, start, m.end())]
        here += [x.span() for x in islice(TOKEN.finditer(text, m.end()), AROUND)]
        beside = bool(found) and not text[done:start].strip(" \t\n\v\f\r\"'")
        for s, e in here:
            found.append((*trimmed(text, s, e), beside))
            beside = True
        done = here[-1][1] if here else m.end()
    return found


class Spans:
    """Base spans of a text by kind, for tests of overlap."""

    def __init__(self, base: list[tuple[int, int, int]]):
        self.starts = [[s for s, k, _ in base if k == kind] for kind in range(len(KINDS))]
        self.ends = [[e for _, k, e in base if k == kind] for kind in range(len(KINDS))]

    def over(self, start: int, end: int) -> list[int]:
        """Kinds of the spans that share a character with start..end; those of one kind do not overlap."""
        return [k for k in range(len(KINDS)) if self.starts[k] and bisect_left(self.starts[k], end) > bisect_right(self.ends[k], start)]


def features(text: str, start: int, end: int, over: list[int]) -> list[int]:
    """Numbers of the features that hold for a token; over: kinds of base spans on it."""
    word = text[start:end]
    digits = NOT_DIGIT.sub("", word)
    n, size = len(digits), len(word)
    on = [0, *[1 + k for k in over]]
    if "@" in word[1:-1]:
        on.append(5)
        if "." in word.partition("@")[2].strip("."):
            on.append(6)
    if word.count(".") == 3 and digits and size == n + 3:
        on.append(7)
    on.append(8 + (0 if n < 1 else 1 if n < 4 else 2 if n < 7 else 3 if n < 9 else 4 if n < 13 else 5 if n < 20 else 6))
    on += [15] if word[0] == "+" else []
    on += [16] if word[:2] == "00" else []
    letters = any(map(str.isalpha, word))
    on += [17] if not letters else [18]
    on += [19] if 12 <= n <= 19 and luhn(digits) else []
    lead = LEADS.get(word.lower().strip(":.,;(#"))
    on += [20 + lead] if lead is not None else []
    on += [26] if "at)" in word or "at]" in word else []
    on += [27] if word == "=" else [28] if text[end : end + 1] in (":", "=") else []
    if not n and "@" not in word:
        on.append(29)
    elif letters and size >= 16 and word.isascii():
        on.append(30)
        on += [31] if size >= 32 else []
        on += [32] if HEXADECIMAL.fullmatch(word) else []
        on += [33] if "-" in word or "/" in word or "." in word or "@" in word else [34]
    on += [35] if word.startswith(("AKIA", "ghp_", "sk-", "xoxb-")) else []
    return on


FEATURES = 36
HEXADECIMAL = re.compile("[0-9a-fA-F]+")


def keys(word: str) -> list[str]:
    """Names under which similar tokens meet."""
    plain = "".join(filter(str.isalnum, word.lower()))
    digits = NOT_DIGIT.sub("", word)
    found = [f"w{plain}"] if len(plain) > 3 else []
    if len(digits) >= 7 and len(digits) >= 0.8 * len(plain):
        found += [f"d{digits[-7:]}"]
    if "@" in word[1:]:
        found += [f"m{word.lower().partition('@')[0]}"]
    return found


class Graph:
    """Tokens of many documents with their features, chain links and skip links."""

    def __init__(self):
        self.columns: list[int] = []
        self.sizes: list[int] = []
        self.links: tuple[list, list] = ([], [])
        self.free: list[bool] = []
        self.n = 0

    def add(self, text: str, spans: list[tuple[int, int, bool]], base: list[tuple[int, int, int]]) -> None:
        seen: dict[str, int] = {}
        held = Spans(base)
        for i, (start, end, beside) in enumerate(spans, self.n):
            over = held.over(start, end)
            on = features(text, start, end, over)
            self.columns += on
            self.sizes.append(len(on))
            self.free.append(not over)
            if beside and i > self.n:
                self.links[0].append((i - 1, i))
            for key in keys(text[start:end]):
                if key in seen:
                    self.links[1].append((seen[key], i))
                seen[key] = i
        self.n += len(spans)

    def infer(self, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of tokens, marginals of links: first the chain's, then the skips) after ROUNDS of damped messages."""
        at = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.intp)
        node = np.add.reduceat(weights.node[self.columns], at, axis=0) if self.n else np.zeros((0, LABELS))
        links = np.array(self.links[0] + self.links[1], np.intp).reshape(-1, 2)
        m, chain = len(links), len(self.links[0])
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        pairs = np.exp(weights.pair)
        # Messages along the chain, along the skips, and back.
        routes = [(slice(0, chain), pairs[0]), (slice(chain, m), pairs[1]), (slice(m, m + chain), pairs[0].T), (slice(m + chain, 2 * m), pairs[1].T)]
        messages = np.zeros((2 * m, LABELS))
        for _ in range(ROUNDS if m else 0):
            out = (node + gather(messages, target, self.n))[source] - messages[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.empty_like(messages)
            for rows, matrix in routes:
                new[rows] = out[rows] @ matrix
            new = np.log(np.maximum(new, 1e-300))
            new -= new.max(axis=1, keepdims=True)
            messages = DAMP * messages + (1 - DAMP) * new
        belief = node + gather(messages, target, self.n) if m else node
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        left, right = belief[links[:, 0]] - messages[m:], belief[links[:, 1]] - messages[:m]
        sides = [np.exp(x - x.max(axis=1, keepdims=True)) if m else x for x in (left, right)]
        both = sides[0][:, :, None] * sides[1][:, None, :]
        both[:chain] *= pairs[0]
        both[chain:] *= pairs[1]
        return p, both / both.sum(axis=(1, 2), keepdims=True)


def gather(messages: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(target, messages[:, k], n) for k in range(LABELS)], axis=1)


class Weights:
    """Potentials of features and of the two kinds of links: along the chain, and symmetrically between similar tokens."""

    def __init__(self):
        self.node = np.zeros((FEATURES, LABELS))
        self.pair = np.zeros((2, LABELS, LABELS))


def examples(count: int = 240, seed: int = 3) -> tuple[Graph, np.ndarray]:
    """Labelled texts made from rules: personal data in full, repeated and in part, among words, numbers and digests."""
    random = np.random.default_rng(seed)
    graph, truth = Graph(), []
    some = lambda chars, n: "".join(random.choice(list(chars), int(n)))
    size = lambda a, b: int(random.integers(a, b))
    digits = lambda n: some("0123456789", n)
    name = lambda: some("abcdefghilmnoprstuéñü", size(2, 9))
    cue = lambda kind: str(random.choice(CUES[kind]))

    def card() -> str:
        body = digits(15)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def things():
        """Texts of one kind that stand together: in full, then similar ones."""
        box, host = some("abcdefghilmnoprstu", size(3, 9)) + digits(2), f"{some('abcdefghilmn', 6)}.{random.choice(['com', 'org', 'example.net'])}"
        number, code, address, full = digits(10), str(random.integers(1, 99)), ".".join(str(x) for x in random.integers(1, 255, 4)), card()
        shape = random.choice(["+{0}{1}{2}", "+{0} {1} {2}", "+{0} ({1}) {2}", "+{0}-{1}-{2}"])
        area, local = number[:3], number[3:]
        key = [lambda: some("0123456789abcdef", size(24, 44)), lambda: some("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", size(20, 44)), lambda: "AKIA" + some("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), lambda: "ghp_" + some("0123456789abcdefghijklmnopqrstuvwxyzABCDEF", 36)][size(0, 4)]()
        yield f"{box}@{host}", f"{box}@{host.partition('.')[0]}", f"{box}(at){host}"
        yield address, f"{address}:80", address
        yield full, " ".join(full[i : i + 4] for i in (0, 4, 8, 12)), f"xxxx-xxxx-{full[-8:]}"
        yield shape.format(code, area, local), f"0{area}{random.choice(['', '-', '/'])}{local}", f"{area}-{local}"
        yield key, key, key

    def noise() -> str:
        return [lambda: digits(size(1, 9)), lambda: digits(16), lambda: digits(10), lambda: digits(24), lambda: f"{digits(3)}.{digits(2)}", lambda: name() + digits(3), lambda: f"v{digits(1)}.{digits(1)}.{digits(1)}", lambda: f"9{digits(2)}.3{digits(2)}.4{digits(2)}.{digits(2)}", lambda: f"{name()}@", lambda: name() + "@2", lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}", lambda: some("0123456789abcdef", size(12, 44)), lambda: f"{some('0123456789abcdef', 8)}-{some('0123456789abcdef', 4)}-{some('0123456789abcdef', 12)}", lambda: f"/{name()}/{name()}{digits(2)}"][size(0, 14)]()

    for _ in range(count):
        parts: list[tuple[str, int]] = []
        plain = lambda n: parts.extend((name(), 0) for _ in range(n))  # noqa: B023, E731
        groups = list(things())
        for kind in random.permutation(len(groups))[: size(0, 4)].tolist():
            for again, text in enumerate(groups[kind][: size(1, 4)]):
                plain(size(1, 4))
                led = random.random() < (0.35 if kind < 4 else 1.0 if not again else 0.3)
                if led:
                    word = cue(kind).upper() if random.random() < 0.1 else cue(kind)
                    parts.append((word + str(random.choice(["", "", ":"])), FIRST_LEAD + kind))
                    parts += [("=", FIRST_LEAD + kind)] if random.random() < 0.4 else []
                parts.append((f'"{text}"' if random.random() < 0.3 else text, 1 + kind))
        for _ in range(size(1, 4)):
            plain(size(1, 4))
            said = noise()
            if random.random() < 0.3:
                parts += [(cue(5) + str(random.choice(["", ":"])), FIRST_LEAD + 5), (said, 0)]
            else:
                parts.append((said, 0))
            if random.random() < 0.2:
                plain(2)
                parts.append((said, 0))
        if random.random() < 0.2:
            parts += [(cue(size(0, 6)), 0)]
        plain(size(1, 4))
        text, label = "", []
        for word, kind in parts:
            text += word + " "
            label += [kind] * (len(word) + 1)
        spans = tokens(text)
        graph.add(text, spans, base_spans(text))
        truth += [label[s] for s, _, _ in spans]
    return graph, np.array(truth)


@lru_cache(maxsize=1)
def train(rounds: int = 150, rate: float = 2.0, ridge: float = 0.00003) -> Weights:
    """Gradient ascent with steps for each weight by what its gradients were so far."""
    graph, truth = examples()
    weights, hot = Weights(), np.eye(LABELS)[truth]
    links = np.array(graph.links[0] + graph.links[1], np.intp).reshape(-1, 2)
    chain = len(graph.links[0])
    rows = np.repeat(np.arange(graph.n), graph.sizes)
    past = [np.zeros_like(weights.node), np.zeros_like(weights.pair)]
    seen = np.stack([np.bincount(k, minlength=LABELS**2).reshape(LABELS, LABELS) for k in np.split(truth[links[:, 0]] * LABELS + truth[links[:, 1]], [chain])])
    for _ in range(rounds):
        p, both = graph.infer(weights)
        node = np.zeros_like(weights.node)
        np.add.at(node, graph.columns, (hot - p)[rows])
        pair = seen - np.stack([both[:chain].sum(axis=0), both[chain:].sum(axis=0)])
        pair[1] = (pair[1] + pair[1].T) / 2
        for values, step, squares in zip((weights.node, weights.pair), (node, pair), past, strict=True):
            step = step / graph.n - ridge * values
            squares += step * step
            values += rate * step / np.sqrt(squares + 1e-8)
    return weights


def find(texts: list[str], weights: Weights) -> tuple[list, list]:
    """Base spans and all spans of each text, as sorted (start, kind, end)."""
    base = [base_spans(t) for t in texts]
    full = [list(b) for b in base]
    graph, spans = Graph(), []

    def label() -> None:
        p = graph.infer(weights)[0]
        best = p.argmax(axis=1)
        for j in np.flatnonzero((best > 0) & (best < FIRST_LEAD) & (p.max(axis=1, initial=0) >= CERTAIN) & np.array(graph.free, bool)).tolist():
            i, start, end = spans[j]
            full[i].append((start, int(best[j]) - 1, end))

    for i, text in enumerate(texts):
        if here := tokens(text):
            graph.add(text, here, base[i])
            spans += [(i, s, e) for s, e, _ in here]
            if graph.n >= GRAPH:
                label()
                graph, spans = Graph(), []
    if graph.n:
        label()
    return base, [sorted(f) for f in full]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive."""
    sent = documents.sparkSession.sparkContext.broadcast(train())
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = find([t or "" for t in batch.column(1).to_pylist()], sent.value)
        columns = [pa.array([[{"kind": SPAN_KINDS[k], "start": s, "end": e} for s, k, e in row] for row in found], pa.list_(span)) for found in both]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return map_steps(ids_and_texts(documents), step, f"doc_id long, base {kind}, spans {kind}")


def redact(documents: DataFrame) -> DataFrame:
    """documents with each span of the text replaced by its kind in brackets; overlapping spans become one."""
    sent = documents.sparkSession.sparkContext.broadcast(train())
    place = documents.columns.index("text")

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for start, kind, end in spans:
            if start >= at:
                out += [text[at:start], f"[{SPAN_KINDS[kind].upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(place).to_pylist()
        found = find([t or "" for t in texts], sent.value)[1]
        new = [t if not spans else clean(t, spans) for t, spans in zip(texts, found, strict=True)]
        return batch.set_column(place, "text", pa.array(new, pa.string()))

    out = map_steps(documents, step, documents.schema, place)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out
