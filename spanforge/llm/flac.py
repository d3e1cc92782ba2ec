"""FLAC media columns: 8-bit mono streams written, checked and read back with numpy over thousands of frames at once.

The encoder cuts a payload into frames of 192 samples, picks for each the cheapest of a constant, a fixed predictor, a
linear predictor of order 4 (Levinson-Durbin on exact integer autocorrelations, quantised to 10 bits) and verbatim
samples, and writes Rice-coded residuals, both checksums, a STREAMINFO with MD5 and a SEEKTABLE. The fast decoder
finds frames by sync code, header checksum and running number, verifies every frame's CRC-16, and then decodes all
frames in step: sample after sample, each numpy call advances every frame by one Rice code and one prediction. Streams
that it does not know (other widths, channels, partitions, escapes) go to `decode_stream`, a plain decoder of one
stream. Decoded PCM comes as blocks with sample offsets, and `seek` starts at the seek point before a sample.

Defined cases: a null text is stored like an empty one, as 192 blanks; texts of any length are stored whole; a damaged
stream raises ValueError; equal texts give equal streams in any batch; rows with one doc_id are each stored; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import ids_and_texts, map_steps, text_bytes

BLOCK = 192
RATE = 8000
#: Frames between two seek points.
SEEK_EVERY = 16
#: Frames that are encoded or decoded in step.
TOGETHER = 4096
ORDER, PRECISION, SHIFT = 4, 10, 8
#: Fixed values of the format: predictors of the orders 0 to 4, nearest sample first.
FIXED = ((0, 0, 0, 0), (1, 0, 0, 0), (2, -1, 0, 0), (3, -3, 1, 0), (4, -6, 4, -1))
#: Two bytes of sync code and fixed blocking, 192 samples at 8 kHz, mono of 8 bits.
HEAD = bytes([0xFF, 0xF8, 0x14, 0x02])


def crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial) & mask if c & top else c << 1 & mask
        out.append(c)
    return np.array(out, np.uint8 if bits == 8 else np.uint16)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)
LEADING = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def crcs(raw: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Checksum of each stretch. Zeros in front leave it alone, so all stretches are brought to one length."""
    if not len(start):
        return np.zeros(0, table.dtype)
    most = int((end - start).max())
    crc = np.zeros(len(start), table.dtype)
    for i in range(most):
        at = end - most + i
        byte = np.where(at >= start, raw[np.maximum(at, 0)], 0)
        crc = table[crc ^ byte] if table.dtype == np.uint8 else table[(crc >> 8) ^ byte] ^ (crc << 8)
    return crc


def number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's UTF-8-like code: bytes (n, 7) and their count."""
    out = np.zeros((len(n), 7), np.uint8)
    size = np.ones(len(n), np.int64)
    for limit in (1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31):
        size += n >= limit
    out[:, 0] = n & 0x7F
    for k in range(2, 8):
        rows = np.flatnonzero(size == k)
        for j in range(k):
            bits = n[rows] >> (6 * (k - 1 - j))
            out[rows, j] = (bits & 0x3F | 0x80) if j else (bits | (0xFF << (8 - k) & 0xFF)) & 0xFF
    return out, size


def levinson(x: np.ndarray) -> np.ndarray:
    """Quantised predictor of each row: elementwise steps only, so that a row's result has no neighbours."""
    r = [(x[:, j:] * x[:, : x.shape[1] - j]).sum(axis=1).astype(np.float64) for j in range(ORDER + 1)]
    a = np.zeros((len(x), ORDER))
    error = np.maximum(r[0], 1.0)
    for i in range(ORDER):
        acc = r[i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * r[i - j]
        k = np.clip(acc / error, -0.999, 0.999)
        before = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1.0)
    most = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -most, most - 1).astype(np.int32)


def residuals(x: np.ndarray, coefficients: np.ndarray, order: int, shift: int) -> np.ndarray:
    """What each row's predictor misses; zero in the warm-up."""
    predicted = np.zeros_like(x)
    for j in range(order):
        predicted[:, order:] += coefficients[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    out = x - (predicted >> shift)
    out[:, :order] = 0
    return out


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames one after another, and each frame's first byte (plus the end). x: samples (frames, 192)."""
    n = len(x)
    lpc = levinson(x)
    plans = [(residuals(x, np.tile(np.array(FIXED[o], np.int32), (n, 1)), o, 0), o, 0) for o in (0, 1, 2)] + [(residuals(x, lpc, ORDER, SHIFT), ORDER, 8 + 9 + ORDER * PRECISION)]
    weight = np.stack([np.abs(r).sum(axis=1) + 8 * extra for r, _, extra in plans])
    best = weight.argmin(axis=0)
    order = np.array([o for _, o, _ in plans])[best]
    rest = np.choose(best[:, None], [r for r, _, _ in plans])
    u = np.where(rest < 0, -2 * rest - 1, 2 * rest)
    columns = np.arange(BLOCK)
    coded = columns >= order[:, None]
    counts = BLOCK - order
    mean = (u.sum(axis=1) // counts).astype(np.int64)
    k = np.clip(np.frexp(mean.astype(np.float64))[1] - 1, 0, 14)
    cost = counts * (k + 1) + ((u >> k[:, None]) * coded).sum(axis=1)
    low = np.maximum(k - 1, 0)
    cost_low = counts * (low + 1) + ((u >> low[:, None]) * coded).sum(axis=1)
    k, cost = np.where(cost_low < cost, low, k), np.minimum(cost, cost_low)
    is_lpc = best == 3
    constant = (x == x[:, :1]).all(axis=1)
    bits = 8 + 8 * order + np.where(is_lpc, 9 + ORDER * PRECISION, 0) + 10 + cost
    verbatim = ~constant & (bits >= 8 + 8 * BLOCK)
    rice = ~constant & ~verbatim
    bits = np.where(constant, 16, np.where(verbatim, 8 + 8 * BLOCK, bits))
    names, name_size = number_bytes(number)
    head = 4 + name_size + 1
    size = head + (bits + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    field = np.zeros(int(start[-1]) * 8, np.uint8)
    place = (start[:-1] + head) * 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(is_lpc, 32 + ORDER - 1, 8 + order)))

    def put(rows: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            field[place[rows] + j] = (value >> (width - 1 - j)) & 1
        place[rows] += width

    every = np.arange(n)
    put(every, kind << 1, 8)
    put(np.flatnonzero(constant), x[constant, 0] & 0xFF, 8)
    for t in range(ORDER):
        rows = np.flatnonzero(rice & (order > t))
        put(rows, x[rows, t] & 0xFF, 8)
    rows = np.flatnonzero(rice & is_lpc)
    put(rows, np.full(len(rows), PRECISION - 1), 4)
    put(rows, np.full(len(rows), SHIFT), 5)
    for j in range(ORDER):
        put(rows, lpc[rows, j] & ((1 << PRECISION) - 1), PRECISION)
    rows = np.flatnonzero(rice)
    put(rows, np.zeros(len(rows), np.int64), 6)
    put(rows, k[rows], 4)
    u, k, coded = u[rows], k[rows], coded[rows]
    high = u >> k[:, None]
    length = np.where(coded, high + 1 + k[:, None], 0)
    stop = place[rows][:, None] + np.cumsum(length, axis=1) - k[:, None] - 1
    stop, value, width = stop[coded], u[coded], np.broadcast_to(k[:, None], u.shape)[coded]
    field[stop] = 1
    for j in range(int(k.max()) if len(k) else 0):  # bit j from the right
        on = ((value >> j) & 1).astype(bool) & (width > j)
        field[stop[on] + width[on] - j] = 1
    raw = np.packbits(field)
    rows = np.flatnonzero(verbatim)  # whole bytes, as the subframe's header is one
    raw[((place[rows] >> 3)[:, None] + columns).ravel()] = x[rows].astype(np.int8).view(np.uint8).ravel()
    for j, byte in enumerate(HEAD):
        raw[start[:-1] + j] = byte
    for j in range(7):
        rows = np.flatnonzero(name_size > j)
        raw[start[rows] + 4 + j] = names[rows, j]
    raw[start[:-1] + head - 1] = crcs(raw, start[:-1], start[:-1] + head - 1, CRC8)
    check = crcs(raw, start[:-1], start[1:] - 2, CRC16)
    raw[start[1:] - 2], raw[start[1:] - 1] = check >> 8, check & 0xFF
    return raw, start


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its length must be a positive multiple of 192 bytes."""
    counts = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.int8).reshape(-1, BLOCK)
    first = np.concatenate([[0], np.cumsum(counts)])
    number = np.arange(len(x)) - np.repeat(first[:-1], counts)
    done = [encode_frames(x[i : i + TOGETHER].astype(np.int32), number[i : i + TOGETHER]) for i in range(0, len(x), TOGETHER)]
    raw = np.concatenate([r for r, _ in done])
    start = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(s) for _, s in done]))])
    out = []
    for payload, a, b in zip(payloads, first[:-1].tolist(), first[1:].tolist(), strict=True):
        sizes = np.diff(start[a : b + 1])
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(payload).digest()
        points = b"".join(struct.pack(">QQH", (i - a) * BLOCK, int(start[i] - start[a]), BLOCK) for i in range(a, b, SEEK_EVERY))
        blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(b"fLaC" + blocks + raw[start[a] : start[b]].tobytes())
    return out


def header(stream: bytes) -> dict:
    """STREAMINFO's fields, seek points and the first frame's place."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, out = 4, False, {"points": []}
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"least": int.from_bytes(body[:2], "big"), "most": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["points"] = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    return out | {"frames": at}


class Bits:
    """Reader of one bit field."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at * 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the stream ends inside a frame")
        value = int.from_bytes(self.data[first:last], "big") >> (last * 8 - self.at - n)
        self.at += n
        return value & (1 << n) - 1

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def crc_of(data: bytes, table: np.ndarray) -> int:
    return int(crcs(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), table)[0])


def decode_frame(stream: bytes, at: int, info: dict) -> tuple[list[list[int]], int]:
    """Channels of the frame at byte `at`, and where it ends."""
    b = Bits(stream, at)
    if b.take(14) != 0x3FFE:
        raise ValueError("no frame here")
    b.take(2)
    block, rate, layout, width = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1)):
        b.take(8)
    size = 192 if block == 1 else 576 << (block - 2) if 2 <= block < 6 else 256 << (block - 8) if block >= 8 else 0
    size = b.take(8) + 1 if block == 6 else b.take(16) + 1 if block == 7 else size
    b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[width]
    if crc_of(stream[at : b.at >> 3], CRC8) != b.take(8):
        raise ValueError("a frame header's checksum is wrong")
    channels = []
    for c in range(layout + 1 if layout < 8 else 2):
        wide = bits + ((layout, c) in ((8, 1), (9, 0), (10, 1)))
        channels.append(decode_subframe(b, size, wide))
    if layout == 8:
        channels[1] = [x - d for x, d in zip(*channels, strict=True)]
    elif layout == 9:
        channels[0] = [d + y for d, y in zip(*channels, strict=True)]
    elif layout == 10:
        middle = [(m << 1 | s & 1, s) for m, s in zip(*channels, strict=True)]
        channels = [[(m + s) >> 1 for m, s in middle], [(m - s) >> 1 for m, s in middle]]
    end = (b.at + 7) >> 3
    if crc_of(stream[at:end], CRC16) != int.from_bytes(stream[end : end + 2], "big"):
        raise ValueError("a frame's checksum is wrong")
    return channels, end + 2


def decode_subframe(b: Bits, size: int, bits: int) -> list[int]:
    b.take(1)
    kind, wasted = b.take(6), b.take(1)
    if wasted:
        wasted += b.unary()
    bits -= wasted
    if kind == 0:
        out = [b.signed(bits)] * size
    elif kind == 1:
        out = [b.signed(bits) for _ in range(size)]
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        out = [b.signed(bits) for _ in range(order)]
        weights, shift = FIXED[order][:order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        width = 4 + b.take(2)
        parts = 1 << b.take(4)
        for part in range(parts):
            k, count = b.take(width), size // parts - (0 if part else order)
            raw = b.take(5) if k == (1 << width) - 1 else None
            for _ in range(count):
                if raw is not None:
                    r = b.signed(raw)
                else:
                    u = b.unary() << k | b.take(k)
                    r = u >> 1 ^ -(u & 1)
                out.append(r + (sum(w * x for w, x in zip(weights, reversed(out), strict=False)) >> shift))
    return [x << wasted for x in out] if wasted else out


def decode_stream(stream: bytes) -> bytes:
    """PCM of any stream, little-endian, channels interleaved; checks every checksum and the MD5."""
    info = header(stream)
    at, out, width = info["frames"], [], (info["bits"] + 7) // 8
    while at < len(stream):
        channels, at = decode_frame(stream, at, info)
        out += [x.to_bytes(width, "little", signed=True) for row in zip(*channels, strict=True) for x in row]
    pcm = b"".join(out)
    if any(info["md5"]) and hashlib.md5(pcm).digest() != info["md5"]:
        raise ValueError("the samples' MD5 is wrong")
    return pcm


def seek(stream: bytes, sample: int) -> tuple[int, bytes]:
    """(offset, PCM) of the frame that holds `sample`, read from the seek point before it."""
    info = header(stream)
    known = [p for p in info["points"] if p[0] <= sample]
    offset, at = known[-1][:2] if known else (0, 0)
    at += info["frames"]
    width = (info["bits"] + 7) // 8
    while at < len(stream):
        channels, at = decode_frame(stream, at, info)
        if offset <= sample < offset + len(channels[0]):
            return offset, b"".join(x.to_bytes(width, "little", signed=True) for row in zip(*channels, strict=True) for x in row)
        offset += len(channels[0])
    raise ValueError("no such sample")


def block(stream: bytes, info: dict, first: int, count: int) -> bytes:
    """PCM of `count` samples from `first`, decoded from the seek point before them on; info: the stream's `header`."""
    points, width = info["points"], info["channels"] * ((info["bits"] + 7) // 8)
    before = bisect_right(points, first, key=lambda p: p[0])
    offset, at = points[before - 1][:2] if before else (0, 0)
    after = bisect_left(points, first + count, key=lambda p: p[0])
    at, end = at + info["frames"], info["frames"] + points[after][1] if after < len(points) else len(stream)
    cut = slice((first - offset) * width, (first - offset + count) * width)
    if (info["least"], info["most"], info["channels"], info["bits"]) == (BLOCK, BLOCK, 1, 8):
        raw = np.frombuffer(stream[at:end] + bytes(16), np.uint8)
        begin = find_frames(raw, 0, end - at)
        if len(begin) and not begin[0] and len(begin) * BLOCK >= first - offset + count:
            samples, good = decode_frames(raw, begin, np.append(begin[1:], end - at), offset // BLOCK + np.arange(len(begin)))
            if good.all():
                return samples.tobytes()[cut]
    found: list[bytes] = []
    held = offset
    while held < first + count:
        channels, at = decode_frame(stream, at, info)
        held += len(channels[0])
        found += [x.to_bytes(width // info["channels"], "little", signed=True) for row in zip(*channels, strict=True) for x in row]
    return b"".join(found)[cut]


def find_frames(raw: np.ndarray, start: int, end: int) -> np.ndarray:
    """First bytes of this encoder's kind of frames between start and end: the sync code and the next number."""
    view = raw[start:end]
    hits = np.flatnonzero((view[:-5] == HEAD[0]) & (view[1:-4] == HEAD[1]) & (view[2:-3] == HEAD[2]) & (view[3:-2] == HEAD[3])) + start
    return hits


def decode(streams: list[bytes]) -> list[bytes]:
    """PCM of each stream; streams of another kind than `encode` writes are decoded one by one."""
    infos = [header(s) for s in streams]
    at = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    raw = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    begins, owners, odd = [], [], []
    for i, info in enumerate(infos):
        count = info["samples"] // BLOCK
        plain = (info["least"], info["most"], info["channels"], info["bits"]) == (BLOCK, BLOCK, 1, 8) and count and not info["samples"] % BLOCK
        hits = find_frames(raw, int(at[i]) + info["frames"], int(at[i + 1])) if plain else np.zeros(0, np.int64)
        if len(hits) != count or hits[0] != at[i] + info["frames"]:
            odd.append(i)
            continue
        begins.append(hits)
        owners.append(i)
    out: list[bytes] = [b""] * len(streams)
    if owners:
        counts = [len(h) for h in begins]
        begin = np.concatenate(begins)
        end = np.concatenate([np.append(h[1:], at[i + 1]) for h, i in zip(begins, owners, strict=True)])
        first = np.concatenate([[0], np.cumsum(counts)])
        number = np.arange(len(begin)) - np.repeat(first[:-1], counts)
        done = [decode_frames(raw, begin[j : j + TOGETHER], end[j : j + TOGETHER], number[j : j + TOGETHER]) for j in range(0, len(begin), TOGETHER)]
        samples, good = np.concatenate([s for s, _ in done]), np.concatenate([g for _, g in done])
        for i, a, b in zip(owners, first[:-1].tolist(), first[1:].tolist(), strict=True):
            pcm = samples[a:b].tobytes()
            if good[a:b].all() and hashlib.md5(pcm).digest() == infos[i]["md5"]:
                out[i] = pcm
            else:
                odd.append(i)
    for i in odd:
        out[i] = decode_stream(streams[i])
    return out


def decode_frames(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, good): frames that fail a check or hold what is not known here are not good."""
    n = len(begin)
    words = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,))
    names, size = number_bytes(number)
    good = crcs(raw, begin, end - 2, CRC16) == (raw[end - 2].astype(np.uint16) << 8 | raw[end - 1])
    good &= crcs(raw, begin, begin + 4 + size, CRC8) == raw[begin + 4 + size]
    for j in range(7):
        good &= (size <= j) | (raw[begin + 4 + j] == names[:, j])
    place = (begin + 5 + size) * 8

    def window(p: np.ndarray) -> np.ndarray:
        return words[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    def take(rows: np.ndarray, width: int, signed: bool = False) -> np.ndarray:
        value = (window(place[rows]) >> np.uint64(64 - width)).astype(np.int64)
        place[rows] += width
        return np.where(value >> (width - 1), value - (1 << width), value) if signed else value

    every = np.arange(n)
    kind = take(every, 8) >> 1
    samples = np.zeros((BLOCK, n), np.int64)
    rows = np.flatnonzero(kind == 0)
    samples[:, rows] = take(rows, 8, True)
    rows = np.flatnonzero(kind == 1)
    samples[:, rows] = raw[(place[rows] >> 3) + np.arange(BLOCK)[:, None]].view(np.int8)
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    good &= (kind < 2) | (kind >= 8) & (kind <= 12) | (kind >= 32) & (order <= ORDER)
    coded = np.flatnonzero((kind >= 8) & good)
    weights, shift = np.zeros((ORDER, n), np.int64), np.zeros(n, np.int64)
    for t in range(ORDER):
        rows = coded[order[coded] > t]
        samples[t, rows] = take(rows, 8, True)
    plain = coded[kind[coded] < 32]
    weights[:, plain] = np.array(FIXED)[order[plain]].T
    rows = coded[kind[coded] >= 32]
    precision = take(rows, 4) + 1
    shift[rows] = take(rows, 5, True)
    known = (precision == PRECISION) & (shift[rows] >= 0)
    good[rows[~known]] = False
    for j in range(ORDER):
        some = rows[order[rows] > j]
        weights[j, some] = take(some, PRECISION, True)
    good[coded[take(coded, 6) != 0]] = False  # another method, or several partitions
    k = take(coded, 4)
    good[coded[k == 15]] = False
    fine = good[coded]
    coded, k = coded[fine], k[fine].astype(np.uint64)
    p, weight, down = place[coded], weights[:, coded], shift[coded]
    first = order[coded]
    history = samples[:, coded]
    one, top, rest = np.uint64(1), np.uint64(48), np.uint64(63) - k
    step = k.astype(np.int64) + 1
    used = int(first.max()) if len(first) else 0
    limit = 8 * (len(raw) - 8)
    for t in range(BLOCK if len(coded) else 0):
        w = window(p)
        q = LEADING[(w >> top).astype(np.intp)]
        value = (w << q.astype(np.uint64) << one >> one >> rest).astype(np.int64)
        long = np.flatnonzero(q == 16)
        if len(long):
            far = p[long]
            while True:
                zero = LEADING[(window(far) >> top).astype(np.intp)]
                far = np.minimum(far + zero, limit)
                if not ((zero == 16) & (far < limit)).any():
                    break
            q[long] = far - p[long]
            value[long] = (window(far) << one >> one >> rest[long]).astype(np.int64)
        u = (q << (step - 1)) | value
        predicted = np.zeros(len(p), np.int64)
        for j in range(min(t, used)):
            predicted += weight[j] * history[t - 1 - j]
        sample = (u >> 1 ^ -(u & 1)) + (predicted >> down)
        if t < used:
            on = first <= t
            history[t] = np.where(on, sample, history[t])
            p = np.where(on, p + q + step, p)
        else:
            history[t] = sample
            p = np.minimum(p + q + step, limit)
    samples[:, coded] = history
    return np.ascontiguousarray(samples.T.astype(np.int8)), good


def features(pcms: list[bytes]) -> list[str]:
    """peak, sum, energy and zero crossings of each payload's signed samples."""
    x = np.frombuffer(b"".join(pcms), np.int8).astype(np.int64)
    at = np.concatenate([[0], np.cumsum([len(p) for p in pcms])])[:-1]
    crossed = np.zeros(len(x), np.int64)
    crossed[1:] = (x[1:] < 0) != (x[:-1] < 0)
    crossed[at] = 0
    rows = zip(*(np.add.reduceat(v, at).tolist() for v in (x, x * x, crossed)), np.maximum.reduceat(np.abs(x), at).tolist(), strict=True)
    return [f"peak={peak};sum={total};energy={energy};crossings={c}" for total, energy, c, peak in rows]


def payload(text: bytes) -> bytes:
    """The text's bytes, filled with blanks to a positive multiple of 192."""
    return text + b" " * (-len(text) % BLOCK if text else BLOCK)


def store(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, flac, pcm, feature): the stream written for each text, and what was read back from it."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = text_bytes(batch.column(1))
        whole = raw.tobytes()
        texts = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        streams = encode(list(map(payload, texts)))
        pcm = decode(streams)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at)), pa.array(streams, pa.binary()), pa.array(pcm, pa.binary()), pa.array(features(pcm))],
            names=["doc_id", "n_bytes", "flac", "pcm", "feature"],
        )

    return map_steps(ids_and_texts(documents), step, "doc_id long, n_bytes long, flac binary, pcm binary, feature string")


def pcm_blocks(stored: DataFrame, frames: int = SEEK_EVERY) -> DataFrame:
    """(doc_id, sample_offset, pcm): decoded blocks of up to `frames` frames of the streams (doc_id, flac).

    A block is found by its sample offset through the stream's seek table and decoded by itself, so that a task holds
    one block of a stream at a time; a null stream has none.
    """

    def run(batches):
        for batch in batches:
            for i, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream is None:
                    continue
                info, size = header(stream), BLOCK * frames
                # A stream that does not say how long it is has to be decoded to find out.
                whole = None if info["samples"] else decode_stream(stream)
                width = info["channels"] * ((info["bits"] + 7) // 8)
                for first in range(0, info["samples"] or len(whole) // width, size):
                    pcm = block(stream, info, first, min(size, info["samples"] - first)) if whole is None else whole[first * width : (first + size) * width]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([first], pa.int64()), pa.array([pcm], pa.binary())], names=["doc_id", "sample_offset", "pcm"])

    return stored.select("doc_id", "flac").mapInArrow(run, "doc_id long, sample_offset long, pcm binary")


ORACLE = f"""
WITH p AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, coalesce(text, '') AS t FROM documents),
q AS (SELECT *, CASE WHEN n = 0 THEN {BLOCK} ELSE n + ({BLOCK} - n % {BLOCK}) % {BLOCK} END AS m FROM p)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(t || repeat(' ', m - n)) AS payload_sha256,
       CAST(ceil(m / {BLOCK * SEEK_EVERY}.0) AS BIGINT) AS n_blocks, m AS block_bytes
FROM q
"""
