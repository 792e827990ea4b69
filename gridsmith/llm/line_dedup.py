"""Line dedup with two Bloom filters: once-seen and twice-seen hashes.

A first pass fills both filters: a hash already in the once-seen filter goes to the twice-seen one. Filters of single tasks
are merged block by block; what two tasks both have once counts as twice. So no line of two documents is missed. Only lines
found in the merged twice-seen filter are shuffled, as digests of 128 bits, to count their documents exactly and to find
their first occurrence. The filters have a fixed size; where lines outnumber it, more lines are suspected, and results stay.
Repeated keys are sent to all tasks if they are few. Else only documents that may hold one, by a filter of the repeated keys,
are joined to them, and all others are passed on where they are.

A line's key is the line without leading and trailing ASCII white space, A-Z lower-cased. A null or empty text is one empty
line; keys shorter than min_chars (the empty key always) are never dropped. A key repeated within one document counts once,
and rows with equal doc_id, null included, count as documents of their own. Other columns are kept; columns with the names
kept, n_lines and n_dropped are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import arrow_map, fresh, map_texts, slices, write_table


@dataclass(frozen=True)
class Settings:
    min_docs: int = 10
    min_chars: int = 1
    #: Keep the first occurrence of a repeated line, by doc_id and place, rather than dropping all.
    keep_first: bool = False
    #: Size of each Bloom filter; a byte or more for each distinct line keeps false suspicions rare.
    filter_bytes: int = 16 << 20
    #: Repeated keys up to so many bytes are sent to all tasks; beyond that they are joined.
    broadcast_bytes: int = 32 << 20


BLOCK = 1 << 14
HASHES = 4
#: Tasks that fill filters at most.
MOST_FILTERS = 2_048


def bit_positions(h: np.ndarray, n_bytes: int) -> np.ndarray:
    """HASHES bit positions of each hash, all in one block."""
    block = (h % np.uint64(n_bytes // BLOCK)).astype(np.int64) * (BLOCK * 8)
    g = K.mix(h ^ np.uint64(0xA5A5_5A5A_0F0F_F0F0))
    return np.stack([block + ((g >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) * 2 % (BLOCK * 8) + (i & 1) for i in range(HASHES)])


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bit_positions(h, len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def put(bits: np.ndarray, h: np.ndarray) -> None:
    at = bit_positions(h, len(bits)).ravel()
    np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))


class Filters:
    """The once-seen and twice-seen filters of one task."""

    def __init__(self, n_bytes: int):
        self.once, self.twice = np.zeros(n_bytes, np.uint8), np.zeros(n_bytes, np.uint8)

    def add(self, h: np.ndarray) -> None:
        """h: hashes of several documents, each document's without repeats."""
        u, n = np.unique(h, return_counts=True)
        put(self.twice, u[(n > 1) | has(self.once, u)])
        put(self.once, u)

    def rows(self):
        o, t = self.once.reshape(-1, BLOCK), self.twice.reshape(-1, BLOCK)
        for i in np.flatnonzero(o.any(axis=1)):
            yield int(i), zlib.compress(o[i].tobytes(), 1), zlib.compress(t[i].tobytes(), 1)


FILTER_SCHEMA = "block int, once binary, twice binary"


def merge_filters(parts: DataFrame, n_bytes: int) -> np.ndarray:
    """The twice-seen filter over all tasks' filters."""
    n_blocks = n_bytes // BLOCK
    # The number of tasks bounds the rows of a block; partitions bound the blocks a task holds.
    dealt = parts.repartition(min(n_blocks, 64), "block")

    def run(batches):
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, o, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if b in once:
                    twice[b] |= t | (once[b] & o)
                    once[b] |= o
                else:
                    once[b], twice[b] = o.copy(), t.copy()
        rows = [(b, zlib.compress(t.tobytes(), 1)) for b, t in twice.items() if t.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "twice"])

    out = np.zeros(n_bytes, np.uint8)
    for r in dealt.transform(arrow_map, run, "block int, twice binary").toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(r["twice"])), np.uint8)
    return out


def twice_seen(df: DataFrame, hashes, n_bytes: int) -> np.ndarray:
    """The twice-seen filter of hashes(batch), which returns each document's hashes without repeats, over df."""

    def run(batches):
        held = Filters(n_bytes)
        for batch in batches:
            for part in slices(batch):
                held.add(hashes(part))
        rows = list(held.rows())
        for lo in range(0, max(len(rows), 1), 256):
            r = rows[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in r], pa.int32()), pa.array([x[1] for x in r], pa.binary()), pa.array([x[2] for x in r], pa.binary())], ["block", "once", "twice"])

    # Each task sends a filter of its own, so the number of tasks bounds what is merged.
    return merge_filters(df.coalesce(MOST_FILTERS).transform(arrow_map, run, FILTER_SCHEMA), n_bytes)


def lines(data: np.ndarray, at: np.ndarray, min_chars: int):
    """(hashes, key starts, key ends, first, usable, folded): each row's lines, their keys' byte spans, and the folded bytes."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    per = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1])
    first = np.zeros(len(at), np.int64)
    np.cumsum(per + 1, out=first[1:])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    start[first[:-1]], end[first[1:] - 1] = at[:-1], at[1:]
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    start[inner] = breaks + 1
    end[np.flatnonzero(inner) - 1] = breaks
    solid = np.flatnonzero(~K.SPACE[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    empty = i == j
    if len(solid):
        ks = np.where(empty, start, solid[np.minimum(i, len(solid) - 1)])
        ke = np.where(empty, start, solid[np.maximum(j - 1, 0)] + 1)
    else:
        ks = ke = start
    folded = K.LOWER[data]
    h = K.safe(K.spans(K.prefix_sums(folded), ks, ke), folded, ks, ke) if n else np.zeros(len(start), np.uint64)
    usable = ~empty
    if min_chars > 1:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        usable &= points[ke] - points[ks] >= min_chars
    return h, ks, ke, first, usable, folded


def once_each(h: np.ndarray, first: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Indices of the first of each row's equal hashes, among those usable."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, row))
    order = order[usable[order]]
    new = np.ones(len(order), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    return order[new]


def digest(folded: np.ndarray, a: int, b: int) -> bytes:
    return hashlib.blake2b(folded[a:b].tobytes(), digest_size=16).digest()


def drop_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with kept (the text that stays), n_lines and n_dropped."""
    spark, text_at, min_chars = docs.sparkSession, docs.columns.index("text"), s.min_chars

    def hashes(batch):
        data, at = K.utf8(batch.column(0))
        out = []
        for lo, hi in K.chunks(at):
            h, _, _, first, usable, _ = lines(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], min_chars)
            out.append(h[once_each(h, first, usable)])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    suspected = spark.sparkContext.broadcast(twice_seen(docs.select("text"), hashes, s.filter_bytes))

    def suspects(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = K.utf8(part.column(1))
                for lo, hi in K.chunks(at):
                    h, ks, ke, first, usable, folded = lines(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], min_chars)
                    i = np.sort(once_each(h, first, usable))
                    i = i[has(suspected.value, h[i])]
                    row = np.searchsorted(first, i, "right") - 1
                    keys = [digest(folded, a, b) for a, b in zip(ks[i].tolist(), ke[i].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array(h[i].view(np.int64)), part.column(0).take(pa.array(row + lo)), pa.array((i - first[row]).astype(np.int32)), part.column(2).take(pa.array(row + lo))],
                        ["key", "h", "id", "line", "t"],
                    )

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("h", T.LongType()), T.StructField("id", id_type), T.StructField("line", T.IntegerType()), T.StructField("t", T.StringType())])

    def suspected_lines(with_text_key: bool) -> DataFrame:
        t = F.md5(F.coalesce("text", F.lit(""))) if with_text_key else F.lit(None).cast("string")
        return docs.select("doc_id", "text", t.alias("t")).transform(arrow_map, suspects, schema)

    repeated = write_table(
        suspected_lines(False)
        .groupBy("key", "h")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "line")).alias("f"))
        .filter(F.col("n") >= s.min_docs)
        .select("key", "h", F.col("f.id").alias("id"), F.col("f.line").alias("line")),
        "repeated-lines",
    )
    added = [("kept", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())]
    id_at, keep_first = docs.columns.index("doc_id"), s.keep_first

    def cut(found_of, text_col, id_col):
        """A function over batches; found_of(batch, row) gives {digest: (first id, first line)} and the hashes."""

        def f(batch):
            data, at = K.utf8(batch.column(text_col))
            n_lines, n_dropped = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            changed = {}
            for lo, hi in K.chunks(at):
                base = at[lo]
                h, ks, ke, first, usable, folded = lines(data[base : at[hi]], at[lo : hi + 1] - base, min_chars)
                n_lines[lo:hi] = np.diff(first)
                for i, found in found_of(batch, h, first, usable, lo):
                    row = int(np.searchsorted(first, i[0], "right") - 1)
                    gone = set()
                    for k in i.tolist():
                        where = found.get(digest(folded, int(ks[k]), int(ke[k])))
                        if where is not None and not (keep_first and where == (batch.column(id_col)[lo + row].as_py(), k - int(first[row]))):
                            gone.add(k - int(first[row]))
                    if gone:
                        raw = data[at[lo + row] : at[lo + row + 1]].tobytes().split(b"\n")
                        changed[lo + row] = b"\n".join(x for j, x in enumerate(raw) if j not in gone).decode("utf-8", "surrogatepass")
                        n_dropped[lo + row] = len(gone)
            text = pc.fill_null(batch.column(text_col), "")
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                text = pc.replace_with_mask(text, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], text.type))
            return {"kept": text, "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}

        return f

    def by_row(i, first):
        """Runs of line indices i, ascending, by row."""
        row = np.searchsorted(first, i, "right") - 1
        return np.split(i, np.flatnonzero(np.diff(row)) + 1) if len(i) else []

    if repeated.count() * 64 <= s.broadcast_bytes:
        rows = repeated.collect()
        sent = spark.sparkContext.broadcast(({bytes(r["key"]): (r["id"], r["line"]) for r in rows}, np.unique(np.array([r["h"] for r in rows], np.int64).view(np.uint64))))

        def make():
            found, hs = sent.value

            def found_of(batch, h, first, usable, lo):
                i = np.flatnonzero(usable & np.isin(h, hs))
                return [(x, found) for x in by_row(i, first)]

            return cut(found_of, text_at, id_at)

        return map_texts(docs, added, make)

    docs = docs.drop(*(n for n, _ in added))
    text_key, found_name, flag = fresh(docs, "text_key", "found", "flag")
    per_text = (
        suspected_lines(True)
        .select("t", "key")
        .distinct()
        .join(repeated.select("key", "id", "line"), "key")
        .groupBy("t")
        .agg(F.collect_list(F.struct("key", "id", "line")).alias(found_name))
        .withColumnRenamed("t", text_key)
    )
    flagged = with_flag(docs, flag, key_filter(repeated, s.filter_bytes), min_chars)
    pass_on = flagged.filter(~F.col(flag)).drop(flag).withColumn(found_name, F.lit(None).cast(per_text.schema[found_name].dataType))
    held = flagged.filter(flag).drop(flag).withColumn(text_key, F.md5(F.coalesce("text", F.lit(""))))
    joined = pass_on.unionByName(held.join(per_text, text_key, "left").drop(text_key))
    found_at, text_in, id_in = (joined.columns.index(c) for c in (found_name, "text", "doc_id"))

    def make():
        def found_of(batch, h, first, usable, lo):
            out = []
            for i in by_row(np.flatnonzero(usable), first):
                row = int(np.searchsorted(first, i[0], "right") - 1)
                got = batch.column(found_at)[lo + row].as_py()
                if got:
                    out.append((i, {x["key"]: (x["id"], x["line"]) for x in got}))
            return out

        return cut(found_of, text_in, id_in)

    return map_texts(joined, added, make).drop(found_name)


def key_filter(repeated: DataFrame, n_bytes: int) -> np.ndarray:
    """A Bloom filter of the repeated keys' hashes; tasks send filters, which have a fixed size, not the keys."""

    def run(batches):
        own = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            put(own, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        got = [(i, own[i : i + BLOCK].tobytes()) for i in range(0, n_bytes, BLOCK) if own[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["at", "bits"])

    out = np.zeros(n_bytes, np.uint8)
    for r in repeated.select("h").coalesce(8).transform(arrow_map, run, "at long, bits binary").toLocalIterator():
        out[r["at"] : r["at"] + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def with_flag(docs: DataFrame, name: str, bits: np.ndarray, min_chars: int) -> DataFrame:
    """docs with a flag: whether any line may have a key of the filter."""
    sent, text_at = docs.sparkSession.sparkContext.broadcast(bits), docs.columns.index("text")

    def make():
        def f(batch):
            data, at = K.utf8(batch.column(text_at))
            out = np.zeros(batch.num_rows, bool)
            for lo, hi in K.chunks(at):
                h, _, _, first, usable, _ = lines(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], min_chars)
                k = np.flatnonzero(usable)
                k = k[has(sent.value, h[k])]
                out[lo + np.searchsorted(first, k, "right") - 1] = True
            return {name: pa.array(out)}

        return f

    return map_texts(docs, [(name, T.BooleanType())], make)


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return drop_lines(docs.select("doc_id", "text"), s).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH keyed AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), line AS (
  SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM keyed
), k AS (
  SELECT r, doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), gone AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT r, doc_id, i, l, key IN (SELECT key FROM gone) AS d FROM k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE d) AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT d), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
