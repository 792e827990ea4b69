"""Repeated-passage dedup by a collection's Burrows-Wheeler order and common prefixes, built column by column.

Every byte covered by a string of `length` bytes that also starts anywhere else, same document included, is removed. Strings are
judged on the input; matches never cross documents; texts are UTF-8 bytes, a null text is empty.

1. Every window of `length` bytes has an anchor: its substring of anchor_bytes(length) bytes with the least hash, the leftmost of
   equals. Equal windows have equal anchors. Windows of one anchor occurrence are consecutive and make up a segment. Hashes of all
   anchors are counted, 4 bytes for each, in KEYS groups; a Bloom filter of those seen twice, as large as their number asks for,
   tells which segments are looked at. That decides nothing: repeated anchors are never missed. Anchors are long, since short ones
   have more different segments, which all have to be compared.
2. A segment that occurs twice in all is repeated as a whole. Where an anchor has several segments and one of them occurs once,
   each distinct segment is a document of a collection. Collections are shards of whole anchors.
3. In a collection the suffixes of all documents are sorted by insertion: each round puts one symbol in front of every document's
   last suffix. Its place follows from the symbol and the place of the suffix behind it, as in a Burrows-Wheeler transform; common
   prefixes with both neighbours follow from the least common prefix between the suffixes behind them. A symbol is a string of
   SYMBOL bytes, told from others by a hash of 64 bits, so a segment is SYMBOL documents, one for each shift, and a window is
   repeated if its suffix shares length/SYMBOL symbols with a neighbour. Wide symbols keep the rounds few, each of which goes
   through the whole order so far.
   The columns of a collection are arrays in memory: shards are bounded by shard_bytes, so nothing goes to files.
4. An anchor of more than most_segments distinct segments, or of more than about two shards' bytes, is cut into single windows,
   dealt by their content, so that no shard grows with the number of copies.

Results are found for each distinct text and joined to its rows. Other columns are kept; columns of the names added are replaced.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import arrow_map, drop_tables, fresh, let_go, map_texts, slices, tidy_group, write_table
from .line_dedup import BLOCK, has, put

SYMBOL = 50
LOW = (1 << 32) - 1
K_BYTES = 16
#: Groups in which hashes of anchors are counted: 8 bits of a key are its group, 32 are sent.
KEYS = 256
#: Anchors whose keys a task holds at most before it sends them.
MOST_KEYS = 1 << 20
#: Bytes of a text that are looked at at once, few enough for a core's cache; longer texts are read in pieces that overlap by a window.
PIECE = 1 << 17


@dataclass(frozen=True)
class Settings:
    #: Bytes of a passage; a multiple of SYMBOL, more than K_BYTES.
    length: int = 200
    #: Bytes of a filter at most; it has two for each anchor put in. Beyond that more segments are looked at, and results stay.
    filter_bytes: int = 64 << 20
    shard_bytes: int = 1 << 20
    most_segments: int = 20_000


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def anchor_bytes(length: int) -> int:
    return max(K_BYTES, length * 2 // 5)


def anchor_keys(h: np.ndarray) -> np.ndarray:
    """40 bits of each anchor's hash, by which it is counted; hashes of anchors are low ones, so they are mixed first."""
    return K.mix(h) >> np.uint64(24)


def anchors(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of every anchor occurrence in rows of bytes; windows are counted by their first byte."""
    none = np.zeros(0, np.int64)
    n, k = len(data), anchor_bytes(length)
    w = length - k + 1
    if n < length:
        return np.zeros(0, np.uint64), none, none
    sums = K.prefix_sums(data)
    m = n - k + 1
    h = (sums[k:] - sums[:-k]) * K.powers(n + 1)[1][:m]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    bits = np.uint64(max(21, int(n).bit_length()))  # the same in pieces of all sizes, for windows to have equal anchors
    low = (h >> bits << bits) | np.arange(m, dtype=np.uint64)  # the place breaks ties and is found again
    size = 1
    while size * 2 <= w:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    whole = np.zeros(len(place) + 1, bool)
    size = np.diff(at)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)[: len(place)]
    whole[:-1] = np.arange(length, len(place) + length) <= np.repeat(at[1:], size)[: len(place)]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~whole[:-2]
    first = np.flatnonzero(change & whole[:-1])
    stop = np.append(first[1:], len(place))
    ends = np.flatnonzero(~whole)
    stop = np.minimum(stop, ends[np.searchsorted(ends, first)])
    return h[place[first]], first, stop - first


def pieces(data: np.ndarray, at: np.ndarray, length: int):
    """(row range, bytes, offsets, place of the first byte in its row): runs of short rows, and long rows in overlapping parts."""
    for lo, hi in K.chunks(at, PIECE):
        if at[hi] - at[lo] <= 2 * PIECE:
            yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], 0
        else:
            for a in range(int(at[lo]), int(at[hi]) - length + 1, PIECE):
                b = min(a + PIECE + length - 1, int(at[hi]))
                yield lo, lo + 1, data[a:b], np.array([0, b - a]), a - int(at[lo])


def insert_columns(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts all suffixes of documents, with one symbol of each document put in a round.

    Document d has the symbols, numbers from 1 on, at begin[d], begin[d] + SYMBOL and so on, size[d] of them.
    Returns, in the order of suffixes, the document, the suffix's length, and the symbols it shares with the one before, depth
    at most. Ends of documents are all different and sort before any symbol.
    """
    n = len(size)
    # A suffix is its first symbol's number and the place of the suffix behind it; ends have the number 0.
    suffix, tag = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64) << 16
    shared, place = np.zeros(n + 1, np.int16), np.arange(n, dtype=np.int64)
    for k in range(1, int(size.max(initial=0)) + 1):
        who = np.flatnonzero(size >= k)
        key = (symbols[begin[who] + SYMBOL * (size[who] - k)] << 32) | place[who]
        order = np.argsort(key)
        who, key = who[order], key[order]
        put = np.searchsorted(suffix, key)
        s, m = len(suffix), len(who)
        new = put + np.arange(m)
        moved = np.cumsum(np.bincount(put, minlength=s + 1))[:s]
        moved += np.arange(s)

        def merged(old, fresh, new=new, moved=moved, total=s + m):
            out = np.empty(total, old.dtype)
            out[moved], out[new] = old, fresh
            return out

        old_shared, suffix, tag = shared, merged(suffix, key), merged(tag, who << 16 | k)
        shared = np.append(merged(shared[:s], 0), np.int16(0))
        # Common prefixes change between a new suffix and its neighbours only.
        touched = np.zeros(s + m + 1, bool)
        touched[new] = touched[new + 1] = True
        touched[0] = touched[s + m] = False
        y = np.flatnonzero(touched)
        here, ahead = suffix[y], suffix[y - 1]
        same = (here >> 32 == ahead >> 32) & (here >> 32 > 0)
        shared[y[~same]] = 0
        shared[y[same]] = np.minimum(1 + least_between(old_shared, (ahead[same] & LOW) + 1, (here[same] & LOW) + 1), depth)
        place = moved[place]
        place[who] = new
        suffix = (suffix & ~LOW) | moved[suffix & LOW]
    return tag >> 16, tag & 0xFFFF, shared[:-1]


def least_between(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a:b] for each pair; ranges that hold a zero are told by counts."""
    zeros = np.concatenate([[0], np.cumsum(x == 0)])
    out = np.zeros(len(a), np.int16)
    rest = np.flatnonzero(zeros[b] == zeros[a])
    if len(rest):
        rest = rest[np.argsort(a[rest], kind="stable")]
        out[rest] = np.minimum.reduceat(x, np.stack([a[rest], b[rest]], 1).ravel())[::2]
    return out


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each distinct segment, which of its windows occur at another place of the collection."""
    size = np.array([len(x) for x in segments], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(segments), np.uint8)
    windows = size - length + 1
    if not len(data):
        return []
    # The symbol that begins at each byte, as a number; those across two segments are never read.
    sums = K.prefix_sums(data)
    m = len(data) - SYMBOL + 1
    _, number = np.unique((sums[SYMBOL:] - sums[:-SYMBOL]) * K.powers(len(data) + 1)[1][:m], return_inverse=True)
    shifts = np.minimum(windows, SYMBOL)
    of = np.repeat(np.arange(len(segments)), shifts)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(shifts) - shifts, shifts)
    count = (size[of] - shift) // SYMBOL
    owner, long, shared = insert_columns(number.astype(np.int64) + 1, at[of] + shift, count, length // SYMBOL)
    need = length // SYMBOL
    twice = (shared >= need) | (np.append(shared[1:], 0) >= need)
    hit = np.flatnonzero(twice & (long >= need))
    d = owner[hit]
    marks = np.zeros(len(data), bool)
    marks[at[of[d]] + shift[d] + (count[d] - long[hit]) * SYMBOL] = True
    return [marks[a : a + w] for a, w in zip(at[:-1].tolist(), windows.tolist())]


def runs(mask: np.ndarray) -> list[int]:
    """Starts and ends of runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()


def repeated_keys(docs: DataFrame, s: Settings) -> DataFrame:
    """(key): keys of the anchors that occur twice."""
    low = np.uint64(LOW)

    def rows_of(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        # More than two of one kind tell no more than two.
        more = np.ones(len(x), bool)
        more[2:] = x[2:] != x[:-2]
        x = x[more]
        edge = np.searchsorted(x, np.arange(KEYS + 1, dtype=np.uint64) << np.uint64(32))
        rows = [(i, (x[a:b] & low).astype(np.uint32).tobytes()) for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if a < b]
        return batch_of(rows, (pa.int32(), pa.binary()), ["part", "keys"])

    def run(batches):
        held, n = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for part in slices(batch):
                data, at = K.utf8(part.column(0))
                for _, _, x, x_at, _ in pieces(data, at, s.length):
                    held.append(anchor_keys(anchors(x, x_at, s.length)[0]))
                    n += len(held[-1])
                    if n >= MOST_KEYS:
                        yield rows_of(held)
                        held, n = [np.zeros(0, np.uint64)], 0
        yield rows_of(held)

    def count(table: pa.Table) -> pa.Table:
        x = np.sort(np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32))
        twice = np.unique(x[1:][x[1:] == x[:-1]]).astype(np.int64)
        return pa.table({"key": twice + (table["part"][0].as_py() << 32)})

    sent = docs.select("text").transform(arrow_map, run, "part int, keys binary")
    return write_table(sent.groupBy("part").applyInArrow(tidy_group(count), "key long"), "keys")


def occurrences(docs: DataFrame, s: Settings) -> DataFrame:
    """(anchor, segment, text_key, start, windows, n): places of segments whose anchor may occur twice, n times in rows of the text."""
    length = s.length
    keys = repeated_keys(docs, s)
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(keys, keys.count(), s.filter_bytes))
    drop_tables(keys)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = K.utf8(part.column(0))
                keys: dict[int, bytes] = {}
                for lo, _, x, x_at, base in pieces(data, at, length):
                    h, first, n = anchors(x, x_at, length)
                    k = np.flatnonzero(has(sent.value, anchor_keys(h)))
                    row = np.searchsorted(x_at, first[k], "right") - 1
                    for r in np.unique(row).tolist():
                        if lo + r not in keys:
                            keys[lo + r] = digest(data[at[lo + r] : at[lo + r + 1]])
                    a, b = first[k].tolist(), (first[k] + n[k] + length - 1).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[k].view(np.int64)),
                            pa.array([digest(x[i:j]) for i, j in zip(a, b)], pa.binary()),
                            pa.array([keys[lo + r] for r in row.tolist()], pa.binary()),
                            pa.array(first[k] - x_at[row] + base, pa.int64()),
                            pa.array(n[k].astype(np.int32)),
                        ],
                        ["anchor", "segment", "text_key", "start", "windows"],
                    )

    found = docs.select("text").transform(arrow_map, run, "anchor long, segment binary, text_key binary, start long, windows int")
    return write_table(found.groupBy("anchor", "segment", "text_key", "start", "windows").agg(F.count("*").alias("n")), "occurrences")


def collections(docs: DataFrame, open_anchors: DataFrame, s: Settings) -> DataFrame:
    """(anchor, segment, offset, shard, bytes): the distinct segments of the given (anchor, segments), or their single windows."""
    spark, length = docs.sparkSession, s.length
    most = min(s.most_segments, 2 * s.shard_bytes // length)
    # A segment that is cut into windows takes the bytes of all of them: half as many as it may have, on average.
    windows = (length - anchor_bytes(length) + 1) / 2
    n_anchors, n = open_anchors.agg(F.count("*"), F.sum(F.when(F.col("segments") > most, F.col("segments") * windows).otherwise(F.col("segments") * 1.5))).first()
    shards = max(1, math.ceil((n or 0) * length / s.shard_bytes))
    sent = spark.sparkContext.broadcast(key_filter(open_anchors.select("anchor"), n_anchors, s.filter_bytes))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = K.utf8(part.column(0))
                seen = set()
                for _, _, x, x_at, _ in pieces(data, at, length):
                    h, first, n = anchors(x, x_at, length)
                    k = np.flatnonzero(has(sent.value, h))
                    rows = []
                    for key, a, m in zip(h[k].view(np.int64).tolist(), first[k].tolist(), n[k].tolist()):
                        seg = x[a : a + m + length - 1]
                        d = digest(seg)
                        if (key, d) not in seen:
                            seen.add((key, d))
                            rows.append((key, d, seg.tobytes()))
                    yield batch_of(rows, (pa.int64(), pa.binary(), pa.binary()), ["anchor", "segment", "bytes"])

    def deal(batches):
        """Segments to the shard of their anchor; those of an anchor of very many, window by window, to the shard of each window."""
        for batch in batches:
            rows = []
            for key, d, seg, segments in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if segments <= most:
                    rows.append((key, d, -1, key % shards, seg))
                    continue
                for t in range(len(seg) - length + 1):
                    w = seg[t : t + length]
                    rows.append((key, d, t, int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "little") % shards, w))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            for lo in range(0, max(len(rows), 1), 4_096):
                yield batch_of(rows[lo : lo + 4_096], kinds, ["anchor", "segment", "offset", "shard", "bytes"])

    found = docs.select("text").transform(arrow_map, run, "anchor long, segment binary, bytes binary").join(open_anchors, "anchor")
    once = found.groupBy("anchor", "segment").agg(F.first("bytes").alias("bytes"), F.first("segments").alias("segments"))
    return once.transform(arrow_map, deal, "anchor long, segment binary, offset int, shard int, bytes binary")


def batch_of(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def key_filter(keys: DataFrame, n: int, most_bytes: int) -> np.ndarray:
    """A Bloom filter of the n longs of keys, in two bytes for each, most_bytes at most."""
    n_bytes = max(BLOCK, min(-(-2 * n // BLOCK) * BLOCK, most_bytes // BLOCK * BLOCK))

    def run(batches):
        own = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            put(own, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for i in range(0, n_bytes, BLOCK):
            if own[i : i + BLOCK].any():
                yield batch_of([(i, own[i : i + BLOCK].tobytes())], (pa.int64(), pa.binary()), ["at", "bits"])

    bits = np.zeros(n_bytes, np.uint8)
    for r in keys.coalesce(8).transform(arrow_map, run, "at long, bits binary").toLocalIterator():
        bits[r["at"] : r["at"] + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(text_key, starts): for each text with any, the first and last + 1 of runs of repeated windows, ascending, in turn."""
    if s.length % SYMBOL or s.length <= K_BYTES:
        raise ValueError(f"length must be a multiple of {SYMBOL} and over {K_BYTES}")
    length = s.length
    places = occurrences(docs, s)
    let_go(docs.sparkSession)
    segments = write_table(places.groupBy("anchor", "segment").agg((F.sum("n") > 1).alias("often")), "segments")
    open_anchors = write_table(segments.groupBy("anchor").agg(F.count("*").alias("segments"), F.min("often").alias("often")).filter("segments > 1 AND NOT often").select("anchor", "segments"), "anchors")

    def run(table: pa.Table) -> pa.Table:
        found = repeated_windows(table["bytes"].to_pylist(), length)
        marks = [runs(m) for m in found]
        return pa.table({"anchor": table["anchor"], "segment": table["segment"], "offset": table["offset"], "marks": pa.array(marks, pa.list_(pa.int32()))})

    marked = collections(docs, open_anchors, s).groupBy("shard").applyInArrow(tidy_group(run), "anchor long, segment binary, offset int, marks array<int>")
    # A window dealt by itself marks its own offset.
    marked = marked.filter(F.size("marks") > 0).select("anchor", "segment", F.when(F.col("offset") < 0, F.col("marks")).otherwise(F.array("offset", F.col("offset") + 1)).alias("marks"))
    marked = write_table(marked.groupBy("anchor", "segment").agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")
    drop_tables(open_anchors)
    let_go(docs.sparkSession)
    # Written, so that both sides of the next join are dealt anew and a segment of very many places can be split.
    known = write_table(segments.join(marked, ["anchor", "segment"], "left").filter("often OR marks IS NOT NULL"), "known")
    drop_tables(segments, marked)
    let_go(docs.sparkSession)
    at = places.join(known, ["anchor", "segment"]).select(
        "text_key",
        F.when(F.col("often"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("windows")).alias("b"))))
        .otherwise(F.expr("transform(sequence(0, greatest(size(marks) div 2 - 1, 0)), i -> struct(start + marks[2 * i] AS a, start + marks[2 * i + 1] AS b))"))
        .alias("runs"),
    )
    return at.groupBy("text_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def drop_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with kept (binary: the bytes that stay), n_bytes, n_removed and spans (start and end of each removed run)."""
    added = [
        ("kept", T.BinaryType()),
        ("n_bytes", T.LongType()),
        ("n_removed", T.LongType()),
        ("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
    docs = docs.drop(*(n for n, _ in added))
    columns, text_at, length = docs.columns, docs.columns.index("text"), s.length
    text_key, runs_name = fresh(docs, "text_key", "runs")

    def keyed():
        def f(batch):
            data, at = K.utf8(batch.column(text_at))
            return {text_key: pa.array([digest(data[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())}

        return f

    found = repeats(docs.select("doc_id", "text"), s).select(F.col("text_key").alias(text_key), F.col("runs").alias(runs_name))
    joined = map_texts(docs, [(text_key, T.BinaryType())], keyed).join(found, text_key, "left").select(*columns, runs_name)
    runs_at = len(columns)

    def make():
        def f(batch):
            data, at = K.utf8(batch.column(text_at))
            kept, removed, spans = [], [], []
            for r in range(batch.num_rows):
                x, got = data[at[r] : at[r + 1]], batch.column(runs_at)[r]
                if not got.is_valid:
                    kept.append(x.tobytes())
                    removed.append(0)
                    spans.append([])
                    continue
                a = got.values.field("a").to_numpy(zero_copy_only=False)
                b = got.values.field("b").to_numpy(zero_copy_only=False)
                delta = np.zeros(len(x) + 1, np.int32)
                np.add.at(delta, a, 1)
                np.add.at(delta, b + length - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = runs(gone)
                kept.append(x[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append([{"start": i, "end": j} for i, j in zip(edge[::2], edge[1::2])])
            return {"kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(np.diff(at)), "n_removed": removed, "spans": spans}

        return f

    return map_texts(joined, added, make).drop(runs_name)


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return drop_repeats(docs.select("doc_id", "text"), s).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 200 bytes by its digest, in parts of 1000 windows, as hexadecimal text.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), part AS (
  SELECT r, a, substr(x, 2 * a + 1, 2 * (1000 + 199)) AS p FROM (SELECT r, x, unnest(range(0, length(x) // 2, 1000)) AS a FROM d)
), w AS (
  SELECT r, a + i AS i, md5_number(substr(p, 2 * i + 1, 400)) AS k
  FROM (SELECT r, a, p, unnest(range(0, least(1000, length(p) // 2 - 199))) AS i FROM part WHERE length(p) >= 400)
), twice AS (
  SELECT k FROM w GROUP BY k HAVING count(*) > 1
), hit AS (
  SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -1000) + 200 AS opens FROM w SEMI JOIN twice USING (k)
), run AS (
  SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(opens::INTEGER) OVER (PARTITION BY r ORDER BY i) AS g FROM hit) GROUP BY r, g
), gap AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM run
  UNION ALL SELECT r, max(b), NULL FROM run GROUP BY r
), kept AS (
  SELECT r, string_agg(CASE WHEN gap.b IS NULL THEN substr(x, 2 * gap.a + 1) ELSE substr(x, 2 * gap.a + 1, 2 * (gap.b - gap.a)) END, '' ORDER BY gap.a) AS x
  FROM gap JOIN d USING (r) GROUP BY r
), gone AS (SELECT r, sum(b - a)::BIGINT AS n, count(*) AS runs FROM run GROUP BY r)
SELECT doc_id, length(d.x) // 2 AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
