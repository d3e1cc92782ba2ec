"""Column building blocks: a let-binding and the span primitive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import MATCH, SPAN

#: Marks put around matches. Texts that hold them get stand-ins of equal length, which no pattern here treats otherwise.
OPEN, CLOSE = "\u0001", "\u0002"
STAND_INS = "\ue000\ue001"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


#: Elements that a growing array holds before it is put away whole: appending copies, so a fold that appends to one array
#: would take time with the square of its length.
LOT = 64


def grown(state: Column, item: Column) -> list[Column]:
    """The fields done and now of a fold's state, `item` added; `whole` makes one array of them."""
    full = F.size(state["now"]) >= LOT
    done = F.when(full, F.array_append(state["done"], state["now"])).otherwise(state["done"])
    now = F.when(full, F.array(item)).otherwise(F.array_append(state["now"], item))
    return [done.alias("done"), now.alias("now")]


def nothing_grown(kind: str) -> list[Column]:
    return [empty(f"array<{kind}>").alias("done"), empty(kind).alias("now")]


def whole(state: Column) -> Column:
    return F.flatten(F.array_append(state["done"], state["now"]))


def running_sums(numbers: Column) -> Column:
    """0 and the sums of the first 1, 2, ... elements of an array of ints."""

    def step(state: Column, x: Column) -> Column:
        total = (state["total"] + x).cast("int")
        return F.struct(*grown(state, total), total.alias("total"))

    start = F.struct(*nothing_grown("int"), F.lit(0).alias("total"))
    return F.aggregate(numbers, start, step, lambda state: F.concat(F.array(F.lit(0)), whole(state)))


#: Pieces that may hold the five words before a match: words may be matches themselves.
AHEAD = 11


def spans(text: Column, pattern: str | tuple[str, str, str], hint: Column | None = None, before: bool = False) -> Column:
    """All leftmost non-overlapping matches of a Java pattern as array<struct<text,start,end>>, in code points.

    The pattern must not refer back to groups. `hint`: a cheap test without which there can be no match. `before`: adds
    the field before, the text from the fifth match before on, or from the start, so that nothing has to be cut from a
    long text once for each match. Three patterns are what stands before, the span itself and what stands behind; a
    character that frames one span can't frame the next.
    """
    front, pattern, back = ("", pattern, "") if isinstance(pattern, str) else pattern

    def cut(parts: Column) -> Column:
        ahead = lambda i: F.array_join(F.slice(parts, F.greatest(i - AHEAD + 1, F.lit(1)), F.least(i, F.lit(AHEAD))), "")
        front = lambda i: [ahead(i).alias("before")] if before else []
        pick = lambda at: lambda i: F.struct(F.get(parts, i).alias("text"), F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), *front(i))
        return let(running_sums(F.transform(parts, F.length)), lambda at: F.transform(F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)), pick(at)))

    kind = SPAN[:-1] + ",before:string>" if before else SPAN
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, STAND_INS), f"(?<front>{front})(?<span>{pattern})(?<back>{back})", f"${{front}}{OPEN}${{span}}{CLOSE}${{back}}")
    found = let(F.split(marked, f"[{OPEN}{CLOSE}]"), lambda parts: F.when(F.size(parts) > 1, cut(parts)).otherwise(empty(kind)))
    test = F.regexp_like(text, F.lit(pattern)) if hint is None else hint
    return F.when(test, found).otherwise(empty(kind))


#: Characters of a piece of text, and pieces that are cut at once.
PIECE, PIECES = 4096, 64


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, as reaching a place inside a long text takes time with its distance."""

    def cut(whole_text: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.length(whole_text) - 1) / size).cast("int")), lambda i: F.substring(whole_text, i * size + 1, F.lit(size)))

    long = F.flatten(F.transform(cut(text, PIECE * PIECES), lambda part: cut(part, PIECE)))
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(long)


def part(cut: Column, start: Column, length: Column) -> Column:
    """`length` characters of a text in `pieces` from `start`, counted from 0."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + length - 1) / PIECE).cast("int")
    near = F.slice(cut, first + 1, F.greatest(last - first + 1, F.lit(1)))
    return F.substring(F.array_join(near, ""), start - first * PIECE + 1, length)


def as_match(span: Column, category: Column | str, confidence: Column | float, detector: str, needs_review: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        span["text"].alias("text"),
        lit(category).alias("category"),
        span["start"].alias("start"),
        span["end"].alias("end"),
        lit(confidence).cast("double").alias("confidence"),
        lit(needs_review).alias("needs_review"),
        F.lit(detector).alias("detector"),
        F.lit(0).alias("seq"),
    )


def numbered(matches: Column) -> Column:
    """Matches with their place in the order of emission as seq."""
    return F.transform(matches, lambda m, i: m.withField("seq", i)).cast(f"array<{MATCH}>")


def around(cut: Column, span: Column, reach: int) -> Column:
    """The span's text with `reach` characters on each side, of a text in `pieces`."""
    start = F.greatest(span["start"] - reach, F.lit(0))
    return part(cut, start, span["end"] + reach - start)


def within(text: Column, found: Column, use: Callable[[Column, Column], Column], kind: str = SPAN) -> Column:
    """`use(pieces of the text, found)`, the text being cut only where something is found."""
    return let(found, lambda spans: F.when(F.size(spans) > 0, let(pieces(text), lambda cut: use(cut, spans))).otherwise(empty(kind)))


def each(rows: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of a costly array, as `name` beside the columns `keep`.

    A plain explode would make the optimizer put a test of the array's size below it, and compute the array twice.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def where_computed(rows: DataFrame, test: Column, *columns: Column | str) -> DataFrame:
    """`columns` of the rows that pass a test on costly columns, without computing these for the test again."""
    packed = F.when(test, F.struct(*columns))
    return each(rows, F.array(packed), "r").select("r.*")
