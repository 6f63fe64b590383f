"""Spans of patterns in texts as DataFrame expressions: positions in code points, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace.functions.text import let

#: What a span is: start, rank of its kind in the listing, end, kind, and the matched text.
SPAN = "struct<s:int,rank:int,e:int,kind:string,match:string>"
NONE = f"array<{SPAN}>"
#: Characters of a block of a text, and a place behind all texts.
BLOCK, _FAR = 256, 2**31 - 1


def none() -> Column:
    return F.array().cast(NONE)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running result of an associative ``step`` over an array: with addition, its running sums.

    Each pass joins every place with the one 1, 2, 4 ... places before it, so that n places take n log n steps.
    """
    passes = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    far = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), F.lit(1), passes)
    join = lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, step(F.get(acc, i - d), x)).otherwise(x))
    return F.aggregate(far, values, join)


def spans(text: Column, pattern: str, kind: str, rank: int, guard: Column) -> Column:
    """All leftmost non-overlapping matches as an array of spans, looked for only where ``guard`` holds.

    Spark gives matches and the text between them, not places; the places are their running lengths.
    Patterns must not match the empty string.
    """
    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        lengths = F.zip_with(matches, gaps, lambda m, g: F.char_length(m) + F.char_length(g))
        ends = let(lengths, lambda x: running(x, lambda a, b: a + b))
        return F.zip_with(matches, ends, lambda m, e: F.struct(
            (e - F.char_length(m)).alias("s"), F.lit(rank).alias("rank"), e.alias("e"), F.lit(kind).alias("kind"), m.alias("match"))).cast(NONE)

    return F.when(guard, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(none())


def apart(found: Column, others: Column) -> Column:
    """The spans that overlap none of the others, sorted: in order of their starts, no earlier one of the others reaches into them, and no
    later one begins in them."""
    marked = lambda xs, own: F.transform(xs, lambda x: F.struct(
        x["s"].alias("s"), x["rank"].alias("rank"), x["e"].alias("e"), x["kind"].alias("kind"), x["match"].alias("match"), F.lit(own).alias("own")))
    ends = lambda xs: F.transform(xs, lambda x: F.when(x["own"], 0).otherwise(x["e"]))
    starts = lambda xs: F.transform(F.reverse(xs), lambda x: F.when(x["own"], _FAR).otherwise(x["s"]))

    def free(xs: Column) -> Column:
        reach = let(ends(xs), lambda v: running(v, lambda a, b: F.greatest(a, b)))
        ahead = F.reverse(let(starts(xs), lambda v: running(v, lambda a, b: F.least(a, b))))
        kept = F.filter(F.arrays_zip(xs.alias("x"), reach.alias("reach"), ahead.alias("ahead")), lambda z: (
            z["x"]["own"] & (z["reach"] <= z["x"]["s"]) & (z["ahead"] >= z["x"]["e"])))
        return F.transform(kept, lambda z: z["x"].dropFields("own")).cast(NONE)

    return F.when((F.size(found) == 0) | (F.size(others) == 0), F.sort_array(found)).otherwise(
        let(F.sort_array(F.concat(marked(found, True), marked(others, False))), free))


def blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` characters, from which ``cut`` takes parts."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in blocks, in time that does not grow with the place."""
    first = F.floor(start / BLOCK).cast("int")
    many = F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(0))
    return F.substring(F.array_join(F.slice(pieces, first + 1, many), ""), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span, or group of overlapping ones, replaced by [kind]. ``found`` is sorted."""
    def replaced(pieces: Column) -> Column:
        ends = let(F.transform(found, lambda x: x["e"]), lambda v: running(v, lambda a, b: F.greatest(a, b)))

        def join(reach: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
            parts = F.transform(found, lambda x, i: F.when(
                x["s"] >= before(i), F.concat(cut(pieces, before(i), x["s"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(""))
            tail = F.array_join(F.slice(pieces, F.floor(F.element_at(reach, -1) / BLOCK).cast("int") + 1, F.size(pieces)), "")
            rest = F.substring(tail, F.element_at(reach, -1) % BLOCK + 1, F.char_length(tail))
            return F.concat(F.array_join(parts, ""), rest)

        return let(ends, join)

    return F.when(F.size(found) == 0, text).otherwise(let(blocks(text), replaced))


def listing(found: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined; empty for none."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def ordered(*found: Column) -> Column:
    """The spans of several arrays by start, then kind as listed."""
    return F.sort_array(F.concat(*found) if len(found) > 1 else found[0])


def without_text(found: Column) -> Column:
    """The same spans with empty matched text, so that nothing secret or personal is written."""
    return F.transform(found, lambda x: x.withField("match", F.lit("")))
