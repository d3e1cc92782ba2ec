"""Mixing sources to target weights with DataFrame operations only.

Sources in order of their code points, null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share all words by weight. A
target stops at `EPOCHS` times what its source has; what it can't take goes to the others by weight, until none is
above. That fixed point is min(EPOCHS * size, level * weight) with one level for all, found by prefix sums over the
sources in order of the ratio at which they fill up.

Within a source documents stand in the order of a hash of their id and text. Whole epochs go to all documents; the rest
of the budget ends at one place of that order, the cut. The range of the hash is divided into equal parts, so that a
source of any size is spread over as many parts as its rows need. Sums per part (aggregated before any shuffle) and
their running sums find the part of the cut, sums per hash inside that part find its hash, and of rows that share even
that, which are equal rows, each gets a number, again by parts. All other documents only compare their hash with their
source's cut, so that neither texts nor rows are sorted or shuffled for it.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows with one doc_id are
documents of their own, as are null ids; equal rows share a place in the order, and it does not matter which of them is
cut; a source without words gets nothing; a text of any length is one document, cut after a word if the budget ends in
it; an empty table gives an empty result; other columns, whatever their names, are kept by `mix` and `expand`, ignored
by the query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

EPOCHS = 3
#: Documents that one part of the hash range holds on average at most, and the number of parts that the hash's leading
#: 20 bits can tell apart.
PART_ROWS, MOST_PARTS = 4096, 1 << 20
#: Sources whose cuts may be broadcast (some 200 bytes each).
BROADCAST_SOURCES = 20_000
SEED = "mix"
#: Characters that do not belong to words: blank and code points 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def sized(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """(row, source, size, key) of documents: the whole row, its source, the words of its text and the hash that
    orders its source. Columns of documents stay inside `row`, whatever their names."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    named = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit("")))
    return documents.select(F.struct("*").alias("row"), F.col("source").alias("source"), size.alias("size"), F.md5(named.cast("binary")).alias("key"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) plus target, one row per source; only this small table is ever in one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    weighed = weighed.withColumns({"total": F.sum("source_size").over(everything), "most": EPOCHS * F.col("source_size")})
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))
    filled = weighed.withColumn("level", left / F.sum("weight").over(from_here)).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    level = F.min(fits).over(everything)["level"]
    filled = filled.withColumn("chosen", level)
    return filled.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * F.col("chosen")).alias("target"))


def running(name: str, order: str, *by: str) -> F.Column:
    """The sum of `name` over the rows of a group that come before in `order`."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(before), F.lit(0))


def with_source(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows beside the columns of plan, one row per source, which is broadcast if these are few."""
    named = plan.withColumnRenamed("source", "plan_source")
    named = F.broadcast(named) if few else named
    return rows.join(named, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def cuts(slim: DataFrame, parts: int | None = None) -> tuple[DataFrame, bool]:
    """(source, source_size, target, epochs, cut, left) of rows (source, size, key), and whether sources are few.

    Documents with a hash below `cut` are taken once more after all epochs, those above are not, and those at it share
    `left` words; a null cut leaves no more for any.
    """
    parts = parts or min(MOST_PARTS, 1 + slim.count() // PART_ROWS)
    part = F.floor(F.conv(F.substring("key", 1, 5), 16, 10).cast("long") * parts / MOST_PARTS)
    rows = slim.withColumn("part", part)
    by_part = durable(rows.groupBy("source", "part").agg(F.sum("size").alias("n")))
    goals = targets(by_part.groupBy("source").agg(F.sum("n").alias("source_size")))
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5D) as bigint) div source_size")).otherwise(0))
    goals = durable(goals.withColumn("over", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(0)))
    few = goals.count() <= BROADCAST_SOURCES
    holds = (F.col("start") <= F.col("over")) & (F.col("over") < F.col("start") + F.col("n"))
    place = with_source(by_part.withColumn("start", running("n", "part", "source")), goals, few).where(holds)
    place = place.select("source", F.col("part").alias("cut_part"), "start", "over")
    inside = with_source(rows, place, few).where("part = cut_part")
    by_key = inside.groupBy("source", "start", "over", "key").agg(F.sum("size").alias("n"))
    by_key = by_key.withColumn("start", F.col("start") + running("n", "key", "source")).where(holds)
    found = by_key.select(F.col("source").alias("cut_source"), F.col("key").alias("cut"), (F.col("over") - F.col("start")).alias("left"))
    planned = goals.drop("over").join(found, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return durable(planned), few


def at_cut(rows: DataFrame, planned: DataFrame, few: bool) -> DataFrame:
    """`rows` at their source's cut, with the columns of `planned` and the words of `left` that each is given as extra."""
    here = with_source(rows, planned, few).where("key = cut").withColumn("tie", F.monotonically_increasing_id())
    here = durable(here)
    lots = 1 + here.count() // PART_ROWS
    here = here.withColumn("lot", F.pmod(F.xxhash64("tie"), F.lit(lots)))
    offsets = here.groupBy("source", "lot").agg(F.count("*").alias("rows")).withColumn("before", running("rows", "lot", "source"))
    offsets = offsets.select(F.col("source").alias("lot_source"), F.col("lot").alias("its_lot"), "before")
    both = here.join(offsets, F.col("source").eqNullSafe(F.col("lot_source")) & (F.col("lot") == F.col("its_lot")))
    number = F.col("before") + F.row_number().over(Window.partitionBy("source", "lot").orderBy("tie")) - 1
    extra = F.least(F.greatest(F.col("left") - number * F.col("size"), F.lit(0)), F.col("size"))
    return both.withColumn("extra", extra.cast("long")).drop("tie", "lot", "lot_source", "its_lot", "before")


def mix(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(row, size, source_size, target, taken) of `sized` rows; taken: words that the mix takes, repeats counted.

    `rows` is read three times; where that is costly, checkpoint it first, without texts.
    """
    planned, few = cuts(rows.select("source", "size", "key"), parts)
    others = with_source(rows, planned, few).where("cut is null or key <> cut").withColumn("extra", F.expr("if(key < cut, size, 0L)"))
    both = others.unionByName(at_cut(rows, planned, few))
    taken = F.col("epochs") * F.col("size") + F.coalesce("extra", F.lit(0))
    return both.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def expand(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """The mix itself, with the columns of documents: a row for each whole copy that is taken, and one cut after its
    last word where the budget ends. n_chars, if there, follows the text.

    Sizes and hashes are checkpointed without texts; texts stay where they are read.
    """
    rows = sized(documents)
    slim = durable(rows.select("source", "size", "key"))
    planned, few = cuts(slim, parts)
    # Words are counted only at the cuts; elsewhere a document needs to know no more than that it has some.
    unread = rows.drop("size").where(F.regexp_like(F.coalesce("row.text", F.lit("")), F.lit(WORD)))
    others = with_source(unread, planned, few).where("cut is null or key <> cut")
    whole = others.select("row", F.expr("cast(epochs + if(key < cut, 1, 0) as int)").alias("copies"), F.lit(0).cast("long").alias("rest"))
    cut = at_cut(rows, planned, few).where("size > 0")
    last = cut.select("row", F.expr("cast(epochs + (extra div size) as int)").alias("copies"), F.expr("extra % size").alias("rest"))
    copies = whole.unionByName(last).where("copies > 0 or rest > 0")
    copies = copies.withColumn("copy", F.explode(F.expr("sequence(1, copies + if(rest > 0, 1, 0))")))
    # The first `rest` words, each with the white space before it.
    words = F.slice(F.regexp_extract_all("row.text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("rest").cast("int"))
    text = F.when(F.col("copy") <= F.col("copies"), F.col("row.text")).otherwise(F.array_join(words, ""))
    out = copies.withColumn("row", F.col("row").withField("text", text))
    if "n_chars" in documents.columns:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast("long")))
    return out.select("row.*")


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, 3 * source_size AS most
  FROM sources),
filled AS (
  SELECT *, row_number() OVER w AS place,
         CAST(total - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
           / CAST(sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST)),
chosen AS (SELECT level AS l FROM filled WHERE most / weight >= level ORDER BY place LIMIT 1),
goals AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (SELECT l FROM chosen)) AS target FROM filled),
placed AS (
  SELECT doc_id, docs.source, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(sum(size) OVER (PARTITION BY docs.source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM docs JOIN goals ON docs.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + least(greatest(budget % source_size - start, 0), size) END AS BIGINT) AS taken
FROM placed
"""
