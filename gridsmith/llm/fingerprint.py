"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

Words are runs between ASCII white space, lower-cased; shingles are WORDS consecutive words, and a text of fewer words, but
not none, is one shingle. Each shingle is hashed once; the hash's low bits choose one of BINS bins and the rest is its value.
The least value of each bin is kept. An empty bin takes the value of the first filled bin along a sequence of its own, the same
for all documents (optimal densification). The low 8 bits of each bin's value are packed, eight bins in a 64-bit number; a
fingerprint is shown as hexadecimal text. Two fingerprints that share a fraction m of their bins have the likeness
(m - c) / (1 - c), 0 at least, where c = 1/256 is what unlike values share by chance.

Bins are made dense by sorting: each bin brings one greatest possible value of its own along, so the first of each bin in
the sorted list is its least value, or that mark where the bin is empty.

A null text counts as empty. A text without words has an empty fingerprint, which is like another empty one (1) and no other (0).
Equal texts have equal fingerprints; repeated rows each get one. doc_id may be a whole number or text; other columns of a frame
given to fingerprint() are kept.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

WORDS = 5
BINS = 128
BIN_BITS = 7
CHANCE = 1 / 256
#: The bits of a value; all set, they mark an empty bin.
VALUE = (1 << 56) - 1
#: Rows that a window's group holds, about, and the most groups.
ROWS_PER_GROUP = 2_000
MOST_GROUPS = 1 << 16
SPACE = " \\t\\n\\u000B\\u000C\\r"


def probe(b: str, j: int) -> str:
    """SQL for the bin that an empty bin b looks at in attempt j: an odd step through all bins, from a start of its own."""
    return f"(shiftright({b} * 40503 + 977, 6) + {j} * (shiftright({b} * 30011 + 4099, 5) & {BINS - 2} | 1)) & {BINS - 1}"


def probes() -> list[list[int]]:
    """For each attempt, the bin that each bin looks at, as probe() has it."""
    return [[((b * 40503 + 977 >> 6) + j * (b * 30011 + 4099 >> 5 & BINS - 2 | 1)) & BINS - 1 for b in range(BINS)] for j in range(BINS)]


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of column text, which holds no null: 16 packed numbers, or none for a text without words."""
    (keyed,) = fresh(df, "keyed")
    trimmed = f"trim(BOTH '{SPACE}' FROM lower(`{text}`))"
    words = f"filter(split({trimmed}, '[ \\t-\\r]+'), w -> w != '')"
    five = ", ".join(f"h[i + {j}]" for j in range(WORDS))
    shingles = f"""CASE WHEN size(h) = 0 THEN array() WHEN size(h) < {WORDS} THEN array(xxhash64(h))
        ELSE transform(sequence(0, size(h) - {WORDS}), i -> xxhash64({five})) END"""
    keys = f"transform({shingles}, x -> shiftleft(x & {BINS - 1}, 56) | (shiftrightunsigned(x, {BIN_BITS}) & {VALUE}L))"
    marks = f"transform(sequence(0, {BINS - 1}), b -> shiftleft(cast(b AS bigint), 56) | {VALUE}L)"
    # transform(array(x), y -> ...)[0] computes x once, whatever uses y.
    once = f"transform(array(transform({words}, w -> xxhash64(w))), h -> {keys})[0]"
    filled = f"transform(array(`{keyed}`), s -> transform(filter(s, (x, i) -> i = 0 OR shiftright(x, 56) != shiftright(get(s, i - 1), 56)), x -> CASE WHEN (x & {VALUE}L) != {VALUE}L THEN x END))[0]"
    tried = ", ".join(f"get(d, {probe('b', j)})" for j in range(BINS))
    dense = f"transform(array({filled}), d -> transform(d, (x, b) -> coalesce(x, {tried})))[0]"
    byte = lambda b: f"shiftleft(get(d, {b}) & 255, {8 * (7 - b % 8)})"
    packed = ", ".join(" | ".join(byte(b) for b in range(k, k + 8)) for k in range(0, BINS, 8))
    # The sorted list is a projection of its own, so that it is sorted by compiled code.
    out = df.withColumn(keyed, F.expr(f"sort_array(concat({once}, {marks}))"))
    value = f"CASE WHEN size(`{keyed}`) = {BINS} THEN cast(array() AS array<bigint>) ELSE transform(array({dense}), d -> array({packed}))[0] END"
    return out.withColumn(name, F.expr(value)).drop(keyed)


def shown(fingerprint: Column) -> Column:
    """A fingerprint as hexadecimal text."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated likeness of two fingerprints' shingle sets."""

    def folded(bits: int):
        return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, bits))

    unlike = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    # The lowest bit of each byte becomes 1 if any bit of the byte is.
    for bits in (4, 2, 1):
        unlike = F.transform(unlike, folded(bits))
    unlike = F.aggregate(unlike, F.lit(0), lambda n, x: n + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101))))
    share = ((BINS - unlike) / F.lit(float(BINS)) - CHANCE) / (1 - CHANCE)
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(F.greatest(share, F.lit(0.0)), 9))


def place_of(df: DataFrame) -> Column:
    """A whole number by which doc_id can be dealt in order: of text, the seven bytes behind what all ids begin with."""
    if isinstance(df.schema["doc_id"].dataType, T.IntegralType):
        return F.col("doc_id").cast("bigint")
    ends = df.agg(F.min(F.col("doc_id").cast("string")).alias("a"), F.max(F.col("doc_id").cast("string")).alias("b")).first()
    same = len(os.path.commonprefix([(ends["a"] or "").encode(), (ends["b"] or "").encode()]))
    seven = F.substring(F.encode(F.col("doc_id").cast("string"), "UTF-8"), same + 1, 7)
    return F.conv(F.rpad(F.hex(seven), 14, "0"), 16, 10).cast("bigint")


def group_bounds(places: DataFrame) -> list[int]:
    """Values of place, ascending, that end groups of about ROWS_PER_GROUP rows; the last is the greatest."""
    n = places.count()
    groups = max(1, min(MOST_GROUPS, n // ROWS_PER_GROUP))
    found = places.agg(F.percentile_approx("place", [(i + 1) / groups for i in range(groups)], max(10_000, 20 * groups)).alias("q"), F.max("place").alias("m")).first()
    return sorted({*(found["q"] or []), *([found["m"]] if found["m"] is not None else [])})


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in descending order of doc_id (ties by text); after the last, the first.

    Groups of rows end at known values of doc_id. The rows of such a value are also dealt to the group above, and those of the
    greatest to the lowest group, as followers only; so each group finds its followers by itself. Null ids come last.
    """
    place = place_of(df)
    bounds = group_bounds(df.select(place.alias("place")))
    all_null = not bounds
    if all_null:  # no row, or null ids only: one group follows itself
        bounds = [0]
    side = max(1, round(len(bounds) ** 0.5))
    # The group of a place is the number of bounds below it, counted by a short list of lists.
    rows = ", ".join(f"array({', '.join(f'{b}L' for b in bounds[i : i + side])})" for i in range(0, len(bounds), side))
    heads = f"array({', '.join(f'{b}L' for b in bounds[::side])})"
    at, own, inner, to, g, k = fresh(df, "at", "place", "inner", "to", "g", "k")
    dealt = df.withColumn(own, place)
    dealt = dealt.withColumn(at, F.expr(f"greatest(size(filter({heads}, b -> b < `{own}`)) - 1, 0)"))
    dealt = dealt.withColumn(inner, F.expr(f"size(filter(array({rows})[`{at}`], b -> b < `{own}`))"))
    group = F.expr(f"CASE WHEN `{own}` IS NULL THEN 0 ELSE `{at}` * {side} + `{inner}` END").cast("int")
    ends = F.expr(f"coalesce(coalesce(get(array({rows})[`{at}`], `{inner}`), get({heads}, `{at}` + 1)) = `{own}`, false)")
    top = F.coalesce(F.col(own) == F.lit(bounds[-1]), F.lit(False))
    follower = lambda where, kind: F.array(F.struct(where.cast("int").alias("g"), F.lit(kind).alias("k")))
    follows = F.when(top, follower(F.lit(0), 2)).when(ends, follower(group + 1, 1)).otherwise(F.array().cast("array<struct<g:int,k:int>>"))
    dealt = dealt.select(*df.columns, F.explode(F.concat(follower(group, 0), follows)).alias(to)).select(*df.columns, F.col(f"{to}.g").alias(g), F.col(f"{to}.k").alias(k))
    # Kind 1, the highest ids of the group below, comes after all own rows; kind 2, the wrap, after these.
    order = Window.partitionBy(g).orderBy(k, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    follower_of = {c: F.lead(c).over(order) for c in columns}
    if all_null:
        follower_of = {c: F.coalesce(x, F.first_value(c).over(order)) for c, x in follower_of.items()}
    return dealt.select("*", *(x.alias(f"next_{c}") for c, x in follower_of.items())).filter(F.col(k) == 0).drop(g, k)


def query(docs: DataFrame) -> DataFrame:
    """The fingerprints of each text and of its edited text: its last half, rounded down, replaced by the start of the next."""
    base = fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fp")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = (
        with_next(base, ["text", "fp"])
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
        .select("doc_id", "n_chars", "edited", "fp", "next_fp")
    )
    return fingerprint(both, "edited", "edited_fp").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("fp")).alias("fingerprint"),
        shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
