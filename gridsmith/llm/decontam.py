"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words are runs of bytes other than ASCII punctuation and white space, A-Z lower-cased. A window is `window` consecutive words
of an item; an item of fewer words, but not none, is one window. As containment must be exact, the prefix of a window is one
word: its rarest over all documents. Documents are joined with windows on that word; a candidate must fit between the ends of
the document at the word's place (the length and positional bounds), and then all its words are compared in order.

Windows are sent to all tasks in blocks of items of at most block_bytes of text, an item that is longer by itself; their words are
counted in one pass over the documents for all blocks. Blocks are matched one behind the other in the same pass, LANES of them at most,
each in a Python worker of its own; more than that are one more pass for every LANES.
Null or empty texts have no words. Windows of items with a null item_id are hits too, but add nothing to item_ids. Rows of items with one
item_id are one item; repeated document rows each get their result. Other columns are kept; columns with the names added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import arrow_map, map_texts, slices, write_table


@dataclass(frozen=True)
class Settings:
    window: int = 10
    #: Text of a block of items: its windows and what is made of them take up to 100 times as much of the driver's memory.
    block_bytes: int = 2 << 20


#: Blocks that are matched in one pass.
LANES = 4
#: Places where a window may begin that are looked at at once.
CANDIDATES = 1 << 19


@dataclass(frozen=True)
class Index:
    tokens: np.ndarray  # sorted prefix words
    first: np.ndarray  # each token's first window
    offset: np.ndarray  # the token's place in the window
    length: np.ndarray
    words: np.ndarray  # a row of word hashes for each window, zeros behind short ones
    items_first: np.ndarray  # each window's first item
    items: np.ndarray  # numbers of items
    names: list[str]


@dataclass(frozen=True)
class Windows:
    """The distinct windows of a block, and which items have them."""

    words: np.ndarray
    length: np.ndarray
    pairs: np.ndarray  # (window, item) of items that have a name
    names: list[str]


def distinct_words(items: list[tuple[str | None, str]]) -> np.ndarray:
    return np.unique(K.words(*K.utf8(pa.array([t for _, t in items], pa.string())), K.ALNUM)[0])


def windows_of(items: list[tuple[str | None, str]], width: int) -> Windows:
    names = sorted({i for i, _ in items if i is not None})
    number = {n: k for k, n in enumerate(names)}
    data, at = K.utf8(pa.array([t for _, t in items], pa.string()))
    h, _, _, first = K.words(data, at, K.ALNUM)
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    of = np.repeat(np.arange(len(items)), count)
    start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size[of], width)
    words = np.zeros((len(of), width), np.uint64)
    # Windows of equal words are told by 128 bits of hashes.
    a, b = length.astype(np.uint64), ~length.astype(np.uint64)
    for j in range(width):
        inside = j < length
        words[inside, j] = h[start[inside] + j]
        a = K.mix(a * np.uint64(0x9E3779B97F4A7C15) + words[:, j])
        b = K.mix(b * np.uint64(0xC2B2AE3D27D4EB4F) ^ words[:, j])
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    window = np.empty(len(order), np.int64)
    window[order] = np.cumsum(new) - 1
    own = np.array([-1 if n is None else number[n] for n, _ in items], np.int64)[of] if len(of) else of
    named = own >= 0
    pairs = np.unique(np.stack([window[named], own[named]], 1), axis=0) if named.any() else np.zeros((0, 2), np.int64)
    one = order[new]
    return Windows(words[one], length[one], pairs, names)


def word_counts(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of vocabulary, sorted hashes, occurs in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = sent.value
        total = np.zeros(len(v), np.int64)
        for batch in batches:
            for part in slices(batch):
                data, at = K.utf8(part.column(0))
                for lo, hi in K.chunks(at):
                    h = K.words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], K.ALNUM)[0]
                    i = np.minimum(np.searchsorted(v, h), len(v) - 1)
                    total += np.bincount(i[v[i] == h], minlength=len(v))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(total[k])], ["k", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in docs.select("text").transform(arrow_map, run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["k"]] = r["n"]
    return out


def build(w: Windows, vocabulary: np.ndarray, counts: np.ndarray) -> Index:
    """The windows by the rarest word of each, the least hash of equally rare ones."""
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, counts))] = np.arange(len(vocabulary))
    ranks = np.full(w.words.shape, len(vocabulary), np.int64)
    for j in range(w.words.shape[1]):
        inside = j < w.length
        ranks[inside, j] = rank[np.searchsorted(vocabulary, w.words[inside, j])]
    offset = ranks.argmin(axis=1) if len(ranks) else np.zeros(0, np.int64)
    token = w.words[np.arange(len(offset)), offset]
    order = np.argsort(token, kind="stable")
    tokens, first = np.unique(token[order], return_index=True)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    window, item = place[w.pairs[:, 0]], w.pairs[:, 1]
    by_window = np.lexsort((item, window))
    items_first = np.searchsorted(window[by_window], np.arange(len(order) + 1))
    return Index(tokens, np.append(first, len(order)).astype(np.int64), offset[order], w.length[order], w.words[order], items_first, item[by_window], w.names)


def expand(first: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, all of first[k]..first[k+1]: (index into k, value)."""
    n = first[k + 1] - first[k]
    which = np.repeat(np.arange(len(k)), n)
    start = np.concatenate([[0], np.cumsum(n)])[:-1]
    return which, first[k][which] + np.arange(len(which)) - start[which]


def match(x: Index, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, windows) of all windows that occur in rows of words h."""
    none = np.zeros(0, np.int64)
    if not len(x.tokens) or not len(h):
        return none, none
    k = np.minimum(np.searchsorted(x.tokens, h), len(x.tokens) - 1)
    pos = np.flatnonzero(x.tokens[k] == h)
    k, row = k[pos], np.searchsorted(first, pos, "right") - 1
    starts, windows = [none], [none]
    # A common word may begin very many candidates: they are made and verified in runs.
    for a, b in K.chunks(np.concatenate([[0], np.cumsum(x.first[k + 1] - x.first[k])]), CANDIDATES):
        which, win = expand(x.first, k[a:b])
        which += a
        start = pos[which] - x.offset[win]
        fits = (start >= first[row[which]]) & (start + x.length[win] <= first[row[which] + 1])
        start, win = start[fits], win[fits]
        for j in range(x.words.shape[1]):
            same = (j >= x.length[win]) | (h[np.minimum(start + j, len(h) - 1)] == x.words[win, j])
            start, win = start[same], win[same]
        starts.append(start)
        windows.append(win)
    return np.concatenate(starts), np.concatenate(windows)


def blocks_of(items: DataFrame, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in runs of at most `most` bytes of text, one at least; rows of one item_id may be in several."""
    held, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    yield held


def find_windows(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with n_words, n_hit (words within occurring windows), hit_spans (their runs: start, end) and item_ids (sorted as strings)."""
    spark = docs.sparkSession
    # In an order of their own, so that both times blocks are the same.
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    items = items.orderBy(F.xxhash64("item_id", "text"), "item_id", "text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("hit_spans", span), ("item_ids", T.ArrayType(T.StringType()))]
    out = docs.drop(*(n for n, _ in added))
    # All that is kept of a block is its distinct words, until its windows are matched.
    words = [distinct_words(block) for block in blocks_of(items, s.block_bytes)]
    vocabulary = np.unique(np.concatenate(words))
    counts = word_counts(docs, vocabulary)
    for b, block in enumerate(blocks_of(items, s.block_bytes)):
        sent = spark.sparkContext.broadcast(build(windows_of(block, s.window), vocabulary, counts))
        text_at, before = out.columns.index("text"), b > 0
        places = [out.columns.index(c) for c in ("hit_spans", "item_ids")] if before else None

        def make(sent=sent, text_at=text_at, places=places):
            x = sent.value

            def f(batch):
                data, at = K.utf8(batch.column(text_at))
                n_words, n_hit, runs, names = [], [], [], []
                old = [batch.column(p).to_pylist() for p in places] if places else None
                for lo, hi in K.chunks(at):
                    h, _, _, first = K.words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], K.ALNUM)
                    start, win = match(x, h, first)
                    delta = np.zeros(len(h) + 1, np.int64)
                    np.add.at(delta, start, 1)
                    np.add.at(delta, start + x.length[win], -1)
                    if old:
                        for k in range(lo, hi):
                            for r in old[0][k]:
                                delta[first[k - lo] + r["start"]] += 1
                                delta[first[k - lo] + r["end"]] -= 1
                    hit = np.cumsum(delta[:-1]) > 0
                    n_words += np.diff(first).tolist()
                    n_hit += K.run_sums(hit.astype(np.int64), first).tolist()
                    edge = np.zeros(len(h) + 1, bool)
                    edge[first] = True
                    begin = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])[: len(hit)]))
                    end = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])[: len(hit)])) + 1
                    row = np.searchsorted(first, begin, "right") - 1
                    own_runs = [[] for _ in range(hi - lo)]
                    for r, a, z in zip(row.tolist(), begin.tolist(), end.tolist()):
                        own_runs[r].append({"start": a - int(first[r]), "end": z - int(first[r])})
                    runs += own_runs
                    which, j = expand(x.items_first, win)
                    own_names = [set(old[1][k]) if old else set() for k in range(lo, hi)]
                    if len(which):
                        row = np.searchsorted(first, start, "right")[which] - 1
                        for c in np.unique(row * len(x.names) + x.items[j]).tolist():
                            own_names[c // len(x.names)].add(x.names[c % len(x.names)])
                    names += [sorted(v) for v in own_names]
                return {"n_words": n_words, "n_hit": n_hit, "hit_spans": runs, "item_ids": names}

            return f

        out = map_texts(out, added, make)
        if (b + 1) % LANES == 0 and b + 1 < len(words):
            out = write_table(out, "windows")
    return out


def query(docs: DataFrame, items: DataFrame, s: Settings = Settings()) -> DataFrame:
    return find_windows(docs.select("doc_id", "text"), items, s).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bp AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bp
), dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n
), dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM dp
), hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
