"""Near-duplicates by one-permutation hashing with optimal densification.

1. A map-only pass makes of each text its set of word shingles, a digest of the set, and a sketch: the hash range is cut
   into `BINS` bins, the smallest hash in a bin stands for it, and an empty bin borrows from the first filled one among
   bins that a hash of (bin, attempt) names, independently for each bin.
2. Texts with equal sets are one class, found by the digest; only classes go on.
3. `ROWS` bins together are a bucket key. Members of a bucket are linked to its centres only (a star), so a bucket of n
   classes makes fewer than 2 n candidate links. The first centre is the member with the most company over all its
   buckets, since the text that others were copied from shares more buckets than its copies do with one another; what
   fails against it is held against the smallest member as well.
4. Candidates are confirmed on the full sets, and links become components.

5. The buckets of one centre make a group. Where a group still holds several components, each member outside the
   largest one meets all others with its full set, in cells of bounded size; a cell counts exact intersections by an
   inverted list and returns no more links than join its components, so nothing grows with the square of a group.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^4)^24 = 3e-6; other links are not missed.

Defined cases: a null or blank text has an empty set, is linked with nothing and keeps its own id; rows with one
doc_id are rows of their own and each gets its class's answer; a null doc_id gets the answer of rows with an equal set,
or null and kept where only null ids have that set; of equally good centres the one with the greater set_id is taken,
which changes no component; a text of any length is one set, held whole by one task; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import ids_and_texts, map_steps, text_bytes
from .components import components
from .durable import durable
from .shingles import mix, shingle_sets

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
#: Shingles, over all sets, of one block of a group; two blocks make a cell.
BLOCK = 1 << 20
#: Ids that may be broadcast (some 40 bytes each).
BROADCAST_IDS = 500_000


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of `bins` 32-bit values for each set; a row of an empty set is zero."""
    out = np.zeros((len(sets), bins), np.uint32)
    full = np.zeros((len(sets), bins), bool)
    for row, hashes in enumerate(sets):
        if len(hashes):
            place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
            first = np.flatnonzero(np.diff(place, prepend=np.uint64(bins)))
            where = place[first].astype(np.intp)
            out[row, where] = hashes[first].astype(np.uint32)
            full[row, where] = True
    row, column = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 0
    while len(row):
        donor = (mix(column.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(attempt + 1)) % np.uint64(bins)).astype(np.intp)
        lucky = full[row, donor]
        out[row[lucky], column[lucky]] = out[row[lucky], donor[lucky]]
        row, column = row[~lucky], column[~lucky]
        attempt += 1
    return out


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def text_key(text: str = "text") -> F.Column:
    """Tells rows with one doc_id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sketch_documents(documents: DataFrame, words: int = 2) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_id, sketch): set_id is a 128-bit digest of the set, null for an empty one."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*text_bytes(batch.column(1)), words)
        digests = [digest(s) if len(s) else None for s in sets]
        flat = pa.array(sketches(sets).view(np.int32).ravel())
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BINS, dtype=np.int32)), flat)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(list(map(len, sets)), pa.int64()), pa.array(digests, pa.binary()), sketch],
            names=["doc_id", "text_key", "n_shingles", "set_id", "sketch"],
        )

    rows = ids_and_texts(documents).withColumn("text_key", text_key())
    return map_steps(rows, step, "doc_id long, text_key long, n_shingles long, set_id binary, sketch array<int>")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, set_id, n_shingles, members) of classes (set_id, n_shingles, sketch) for buckets of two or more."""
    bands = ", ".join(f"xxhash64({i}, slice(sketch, {i * ROWS + 1}, {ROWS}))" for i in range(BANDS))
    rows = classes.select("set_id", "n_shingles", F.explode(F.expr(f"array({bands})")).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(shared, "bucket")


def centred(rows: DataFrame) -> DataFrame:
    """Members (set_id, n_shingles) of buckets with their buckets' centres `first` and `second`, each (id, n)."""
    company = rows.groupBy("set_id").agg(F.sum("members").alias("company"))
    rows = rows.join(company, "set_id")
    me = F.struct("company", F.col("set_id").alias("id"), F.col("n_shingles").alias("n"))
    centres = rows.groupBy("bucket").agg(F.max(me).alias("first"), F.min(F.struct(F.col("set_id").alias("id"), F.col("n_shingles").alias("n"))).alias("second"))
    return rows.join(centres, "bucket").select("set_id", "n_shingles", F.struct("first.id", "first.n").alias("first"), "second").distinct()


def star(members: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b) of set ids: links from each bucket's centres to its members, the centre first."""
    pairs = members.select(F.explode(F.array("first", "second")).alias("c"), F.col("set_id").alias("b"), "n_shingles")
    near = pairs.where(f"c.id <> b and 100 * least(c.n, n_shingles) >= {percent} * greatest(c.n, n_shingles)")
    return near.select(F.col("c.id").alias("a"), "b").distinct()


def mixed_groups(members: DataFrame, found: DataFrame) -> DataFrame:
    """(centre, set_id, root, asks, own, others): members of groups that hold several components of `found` (node, root).

    asks: the member lies outside the group's largest component; own, others: blocks of those that ask, and of all.
    """
    groups = members.select(F.col("first.id").alias("centre"), "set_id", "n_shingles").distinct()
    rooted = groups.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = durable(rooted.select("centre", "set_id", "n_shingles", "root"))
    sizes = rooted.groupBy("centre", "root").agg(F.sum("n_shingles").alias("n")).groupBy("centre")
    mixed = sizes.agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main")).where("components > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("long")
    mixed = mixed.select("centre", F.col("main.root").alias("main"), blocks(F.col("n")).alias("others"), blocks(F.col("n") - F.col("main.n")).alias("own"))
    return rooted.join(mixed, "centre").select("centre", "set_id", "root", (F.col("root") != F.col("main")).alias("asks"), "own", "others")


def links_in_cell(asking: list[np.ndarray], sets: list[np.ndarray], percent: int = 80):
    """For each set of `asking`, the places of those in `sets` that it is linked with."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for mine in asking:
        low, high = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        yield np.flatnonzero(100 * common >= percent * (len(mine) + sizes - common))


def rest(mixed: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """(a, b): links that join components of mixed groups. sets: (set_id, hashes) of their members.

    Both sides are cut into blocks by a hash; a block of those that ask meets each block of all members in one cell.
    """
    rows = mixed.join(sets, "set_id")
    number = lambda n: F.pmod(F.xxhash64("set_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("set_id", "root", "hashes")
    met = rows.where("asks").select("centre", number("own").alias("o"), each("others").alias("a"), F.lit(True).alias("asks"), *columns)
    met = met.unionByName(rows.select("centre", each("own").alias("o"), number("others").alias("a"), F.lit(False).alias("asks"), *columns))

    def cell(table: pa.Table) -> pa.Table:
        asks = np.asarray(table.column("asks").to_pylist(), bool)
        ids, roots = table.column("set_id").to_pylist(), table.column("root").to_pylist()
        hashes = [np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()]
        mine, others = np.flatnonzero(asks).tolist(), np.flatnonzero(~asks).tolist()
        up: dict[bytes, bytes] = {}

        def top(root: bytes) -> bytes:
            while root in up:
                root = up[root]
            return root

        pairs = []
        for i, near in zip(mine, links_in_cell([hashes[i] for i in mine], [hashes[j] for j in others], percent), strict=True):
            for j in near.tolist():
                x, y = top(roots[i]), top(roots[others[j]])
                if x != y:
                    up[x] = y
                    pairs.append((ids[i], ids[others[j]]))
        return pa.table({n: pa.array([p[k] for p in pairs], pa.binary()) for k, n in enumerate("ab")})

    return met.groupBy("centre", "o", "a").applyInArrow(cell, "a binary, b binary")


def of_classes(documents: DataFrame, needed: DataFrame, words: int, column: str) -> DataFrame:
    """(set_id, text or hashes): one text, or its set, of each class of needed (set_id, rep), found by the set and not
    by the id alone, since rows with one doc_id may carry different texts."""
    # A few ids find their texts where these lie; beyond the bound texts are shuffled to them.
    hint = "broadcast" if needed.count() <= BROADCAST_IDS else "merge"
    rows = ids_and_texts(documents).join(needed.select(F.col("rep").alias("doc_id")).distinct().hint(hint), "doc_id", "left_semi")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*text_bytes(batch.column(1)), words)
        digests = [digest(s) if len(s) else None for s in sets]
        values = batch.column(1) if column == "text" else pa.array([s.tobytes() for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), values], names=["set_id", column])

    named = map_steps(rows.select("doc_id", "text"), step, f"set_id binary, {column} {'string' if column == 'text' else 'binary'}")
    named = named.join(needed.select("set_id").hint(hint), "set_id", "left_semi")
    return named.groupBy("set_id").agg(F.first(column).alias(column))


def confirm(pairs: DataFrame, texts: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: (set_id, text), one of each."""
    with_b = pairs.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        others = shingle_sets(*text_bytes(batch.column(1)), words)
        keys = batch.column(0).to_pylist()
        fresh = [i for i, k in enumerate(keys) if not i or keys[i - 1] != k]
        centre = shingle_sets(*text_bytes(batch.column(2).take(pa.array(fresh))), words)
        which = np.searchsorted(fresh, np.arange(len(keys)), side="right") - 1
        keep = []
        for i, other in enumerate(others):
            mine = centre[which[i]]
            common = len(np.intersect1d(mine, other, assume_unique=True))
            keep.append(100 * common >= percent * (len(mine) + len(other) - common))
        return batch.select([0, 3]).filter(pa.array(keep))

    return map_steps(both.select("a", "text_b", "text_a", "b"), step, "a binary, b binary")


def near_duplicates(documents: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of documents."""
    out = classified(documents, words, percent).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(documents: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """documents, all columns, with one row of each group of near-duplicates: of the rows with its smallest doc_id the one
    whose text has the smallest hash. Rows without words all stay, equal rows of them once. A row without an id counts as
    one with a large id made of its text, so that it goes where any other row of its group has an id."""
    made = F.lit(1 << 62) + F.pmod(text_key(), F.lit(1 << 61))
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), made).alias("doc_id"), "text")
    groups = durable(classified(rows, words, percent).where("doc_id = component_id").select("doc_id", "text_key", "group"))
    # Texts stay where they are read, but for the few rows that stand there more than once.
    each = groups.groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    first = each.where("group is not null").groupBy("group", "doc_id").agg(F.min(F.struct("text_key", "copies")).alias("first"))
    kept = durable(first.select("doc_id", "first.*").unionByName(each.where("group is null").drop("group")))
    hint = "broadcast" if kept.count() <= BROADCAST_IDS else "merge"
    found = rows.withColumn("text_key", text_key()).join(kept.hint(hint), ["doc_id", "text_key"])
    again = found.where("copies > 1").dropDuplicates(["doc_id", "text_key"])
    return found.where("copies = 1").unionByName(again).select("row.*")


def classified(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, group, component_id) of every row of documents; group names the component, also where
    components share an id, and is null for an empty set."""
    sketched = durable(sketch_documents(documents, words))
    members = sketched.where("set_id is not null").groupBy("set_id")
    classes = members.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    rows = durable(centred(shared_buckets(classes.where("rep is not null"))))
    reps = durable(members.agg(F.min("doc_id").alias("rep")))
    pairs = durable(star(rows, percent))
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct().join(reps, "set_id"))
    links = durable(confirm(pairs, of_classes(documents, needed, words, "text"), words, percent))
    mixed = durable(mixed_groups(rows, components(links)))
    needed = durable(mixed.select("set_id").distinct().join(reps, "set_id"))
    links = links.unionByName(durable(rest(mixed, of_classes(documents, needed, words, "hashes"), percent)))
    found = components(links).join(reps.withColumnRenamed("set_id", "node"), "node")
    roots = found.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = found.join(roots, "root").select(F.col("node").alias("set_id"), "root", "component_id")
    answer = reps.join(linked, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("group"), F.coalesce("component_id", "rep").alias("component_id"))
    out = sketched.select("doc_id", "text_key", "n_shingles", "set_id").join(answer, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_key", "n_shingles", "group", component.alias("component_id"))
