"""SentencePiece encoding and decoding by forward-filtering backward-sampling.

The pieces and scores are those of a given SentencePiece model file; nothing is trained. A text becomes units: a run of spaces with
the run of other characters behind it, but each line feed alone. Spaces are written as the piece sign U+2581. The lattice of a unit
has an edge for each piece that occurs in it; a character without a piece of its own has its UTF-8 bytes' pieces as its one edge.
An edge weighs exp(alpha * score): for a unigram model score is the piece's logarithmic probability, for a BPE model, whose scores
are merge ranks, it is -log(rank + 1). Forward filtering sums the weights of all paths to each place; backward sampling
then draws each edge from the unit's end on in proportion to the sums, so a segmentation is drawn with its exact probability.
All draws are hashes of (seed, row key, unit number, draw number): the same row key and text get the same pieces in every run.

The lattice is filtered once for each distinct unit of CHUNK bytes of text; all its units are sampled at once. A unit of over LONG_UNIT
bytes is filtered and sampled by itself, place by place, in parts of PART bytes, with its exact chances too; all that is held of it whole
is one sum for each byte.
Decoding joins pieces and bytes; it gives back every text exactly, U+2581 in a text included, as that is encoded by its bytes.
A null text has null ids and decodes to null; an empty text has no ids. Rows of equal keys and texts have equal ids; a null key
is a key of its own. Other columns are kept; columns with the names added are replaced.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import map_texts

SIGN = "▁"
#: Units of more bytes are filtered by themselves.
LONG_UNIT = 1_024
#: Bytes of a long unit whose edges are held at once.
PART = 1 << 16
HIGH = np.uint64(42)
#: Bytes of text whose lattices are filtered together.
CHUNK = 1 << 20
#: Where the model file is unless Settings name one: the variable GRIDSMITH_PIECE_MODEL on the driver, else this path.
DEFAULT_MODEL = os.environ.get("GRIDSMITH_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


@dataclass(frozen=True)
class Settings:
    model_file: str = DEFAULT_MODEL
    alpha: float = 1.0
    seed: int = 1


@dataclass(frozen=True)
class Vocabulary:
    hashes: np.ndarray  # of the pieces' bytes, ascending
    heads: np.ndarray  # the first piece for each value of a hash's high bits, -1 for none
    most: int  # pieces that share their high bits at most
    ids: np.ndarray
    weights: np.ndarray  # logarithmic
    lengths: tuple[int, ...]  # in bytes, of any piece
    byte_ids: np.ndarray
    texts: tuple[bytes, ...]  # what each id decodes to


def load(s: Settings = Settings()) -> Vocabulary:
    """The model file's pieces; it is read on the driver only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=s.model_file)
    byte_ids, texts, found = np.full(256, -1, np.int64), [], {}
    scores = [sp.get_score(i) for i in range(sp.vocab_size())]
    ranked = min(scores) < -1_000  # merge ranks, not logarithms
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            texts.append(bytes([int(piece[3:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            texts.append(piece.replace(SIGN, " ").encode())
            score = -float(np.log(min(-scores[i], sp.vocab_size()) + 1)) if ranked else scores[i]
            found.setdefault(texts[-1], (i, s.alpha * score))
    if byte_ids.min() < 0:
        raise ValueError("the model has no pieces for single bytes, so not every text can be decoded")
    size = np.array([len(t) for t in found], np.int64)
    end = np.cumsum(size)
    h = K.spans(K.prefix_sums(np.frombuffer(b"".join(found), np.uint8)), end - size, end)
    order = np.argsort(h)
    ids, weights = (np.array([v[k] for v in found.values()])[order] for k in (0, 1))
    h = h[order]
    high, first, many = np.unique((h >> HIGH).astype(np.int64), return_index=True, return_counts=True)
    heads = np.full(1 << (64 - int(HIGH)), -1, np.int32)
    heads[high] = first
    return Vocabulary(h, heads, int(many.max()), ids.astype(np.int64), weights.astype(float), tuple(sorted(set(size.tolist()))), byte_ids, tuple(texts))


def find(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the hashes are pieces', the pieces' numbers)."""
    k = v.heads[(h >> HIGH).astype(np.int64)]
    at = np.flatnonzero(k >= 0)
    k, h = k[at].astype(np.int64), h[at]
    for _ in range(v.most - 1):
        k += (v.hashes[k] != h) & (k + 1 < len(v.hashes))
    same = v.hashes[k] == h
    return at[same], k[same]


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts and the end, first): the units of each row."""
    n = len(data)
    space, feed = data == 32, data == 10
    begin = feed | (space & ~np.concatenate([[False], space[:-1]])) | np.concatenate([[False], feed[:-1]])
    begin[at[:-1][at[:-1] < n]] = True
    start = np.append(np.flatnonzero(begin), n)
    return start, np.searchsorted(start[:-1], at)


def found_edges(v: Vocabulary, x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last byte, size, piece id, weight) of every edge of units of bytes x; base is the place where each byte's unit begins."""
    n = len(x)
    sums = K.prefix_sums(x)
    lead = (x & 0xC0) != 0x80
    of_char = np.maximum.accumulate(np.where(lead, np.arange(n), 0)) if n else base
    ends, froms, ids, weights = [], [], [], []
    known = np.zeros(n, bool)  # bytes whose character is a piece by itself, at its last byte
    depth = np.arange(n) - base
    far = np.arange(n)
    for size in v.lengths:
        far = far[depth[far] >= size - 1]
        if not len(far):
            break
        which, k = find(v, K.spans(sums, far - (size - 1), far + 1))
        e = far[which]
        known[e[of_char[e] == e - size + 1]] = True
        ends.append(e)
        froms.append(e - size)
        ids.append(v.ids[k])
        weights.append(v.weights[k])
    char_end = np.flatnonzero(np.append(lead[1:], True)) if n else np.zeros(0, np.int64)
    bare = ~np.repeat(known[char_end], np.diff(np.append(of_char[char_end], n))) if n else known
    e = np.flatnonzero(bare)
    ends.append(e)
    froms.append(e - 1)
    ids.append(v.byte_ids[x[e]])
    weights.append(np.full(len(e), -8.0))
    end, back, piece, w = (np.concatenate(c) for c in (ends, froms, ids, weights))
    return end, end - back, piece, w


@dataclass
class Lattices:
    """Edges of distinct units by the byte they end at."""

    last: np.ndarray  # each unit's last byte, a node
    key: np.ndarray  # an edge's cumulative chance within its node, plus the node
    back: np.ndarray  # the node an edge comes from, -1 for the unit's start
    piece: np.ndarray  # its id
    first: np.ndarray  # each node's first edge


def lattices(v: Vocabulary, x: np.ndarray, start: np.ndarray) -> Lattices:
    """The filtered lattices of units of bytes x that begin at start, the end of x included."""
    n = len(x)
    base = np.repeat(start[:-1], np.diff(start))
    end, size, piece, w = found_edges(v, x, base)
    back = end - size
    # Keys of sorts are all different, so that every machine sorts alike; a node has one edge of each size.
    size = np.minimum(size, 1023)
    depth = end - base[end]
    back = np.where(back < base[end], -1, back)
    order = np.argsort((depth * n + end) << 10 | size)
    by_end = (end << 10 | size)[order]
    end, back, piece, w, depth = end[order], back[order], piece[order], w[order], depth[order]
    total, chance = np.zeros(n), np.zeros(len(end))
    bounds = np.searchsorted(depth, np.arange(depth[-1] + 2)) if len(depth) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            continue
        t = w[a:b] + np.where(back[a:b] >= 0, total[back[a:b]], 0.0)
        new = np.flatnonzero(np.concatenate([[True], end[a + 1 : b] != end[a : b - 1]]))
        many = np.diff(np.append(new, b - a))
        top = np.maximum.reduceat(t, new)
        run = np.cumsum(np.exp(t - np.repeat(top, many)))
        before = np.concatenate([[0.0], run[new[1:] - 1]])
        run -= np.repeat(before, many)
        whole = run[np.append(new[1:], b - a) - 1]
        total[end[a:b][new]] = top + np.log(whole)
        chance[a:b] = run / np.repeat(whole, many)
    order = np.argsort(by_end)
    end = end[order]
    return Lattices(start[1:] - 1, end + chance[order] * (1 - 1e-9), back[order], piece[order], np.searchsorted(end, np.arange(n + 1)))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """One number in [0, 1) for each key."""
    return (K.mix(keys + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def distinct(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each unit's text, first unit of each number); units longer than hashes are safe for are all told apart."""
    h = K.spans(K.prefix_sums(data), start[:-1], start[1:])
    long = np.flatnonzero(np.diff(start) > K.LONG)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    if len(long):
        number[long] = len(first) + np.arange(len(long))
        first = np.concatenate([first, long])
    return number, first


def unit_runs(start: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of units: each long one by itself, and between these as many as make CHUNK bytes."""
    n, a = len(start) - 1, 0
    for k in [*np.flatnonzero(np.diff(start) > LONG_UNIT).tolist(), n]:
        for lo, hi in K.chunks(start[a : k + 1], CHUNK):
            yield a + lo, a + hi
        if k < n:
            yield k, k + 1
        a = k + 1


def sample(v: Vocabulary, data: np.ndarray, at: np.ndarray, row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows and each row's first."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    start, first = units(data, at)
    n_units = len(start) - 1
    row = np.searchsorted(first, np.arange(n_units), "right") - 1
    salt = K.mix(row_keys[row] ^ K.mix((np.arange(n_units) - first[row]).astype(np.uint64)))
    parts, sizes = [], np.zeros(n_units, np.int64)
    for a, b in unit_runs(start):
        x = data[start[a] : start[b]]
        if len(x) > LONG_UNIT and b == a + 1:
            ids = sample_long(v, x, salt[a])
            sizes[a] = len(ids)
        else:
            ids, sizes[a:b] = sample_units(v, x, start[a : b + 1] - start[a], salt[a:b])
        parts.append(ids)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])[first]


def edges(v: Vocabulary, x: np.ndarray, a: int, b: int) -> tuple[list[int], list[int], list[float], list[int]]:
    """The edges that end at bytes a to b of the unit x, by end and size: (first edge of each byte, sizes, weights, ids)."""
    # Back to a character's start that is far enough for any piece.
    lo = max(0, a - max(v.lengths) - 4)
    while lo and x[lo] & 0xC0 == 0x80:
        lo -= 1
    hi = b
    while hi < len(x) and x[hi] & 0xC0 == 0x80:
        hi += 1
    end, size, piece, w = found_edges(v, x[lo:hi], np.zeros(hi - lo, np.int64))
    keep = (end >= a - lo) & (end < b - lo)
    end, size, piece, w = end[keep], size[keep], piece[keep], w[keep]
    order = np.lexsort((size, end))
    bounds = np.searchsorted(end[order], np.arange(a - lo, b - lo + 1))
    return bounds.tolist(), size[order].tolist(), w[order].tolist(), piece[order].tolist()


def sample_long(v: Vocabulary, x: np.ndarray, salt: np.uint64) -> np.ndarray:
    """The ids of one long unit: sums forward over all places, then draws backward, part by part."""
    n = len(x)
    # total[i] is the logarithm of the sum over all paths to the place behind i bytes; none reach the inside of some characters.
    total = [0.0] + [-math.inf] * n
    exp, log = math.exp, math.log
    for a in range(0, n, PART):
        b = min(a + PART, n)
        bounds, size, w, _ = edges(v, x, a, b)
        for i in range(b - a):
            t = [w[k] + total[a + i + 1 - size[k]] for k in range(bounds[i], bounds[i + 1])]
            if t and (top := max(t)) > -math.inf:
                total[a + i + 1] = top + log(sum([exp(y - top) for y in t]))
    out: list[int] = []
    place, held_from = n, n
    keys = np.array([salt], np.uint64)
    draws: list[float] = []
    while place:
        if place <= held_from:
            held_from = max(0, place - PART)
            bounds, size, w, piece = edges(v, x, held_from, place)
        i = place - 1 - held_from
        if len(out) >= len(draws):
            at = np.arange(len(draws), len(draws) + 4_096)
            draws += uniform_draws(keys, at).tolist()
        left = draws[len(out)] * (1 - 1e-9)
        for k in range(bounds[i], bounds[i + 1]):
            chance = exp(w[k] + total[place - size[k]] - total[place])
            chosen = k
            left -= chance
            if left < 0:
                break
        out.append(piece[chosen])
        place -= size[chosen]
    return np.array(out[::-1], np.int64)


def sample_units(v: Vocabulary, data: np.ndarray, start: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each unit) of units that are not long."""
    number, of = distinct(data, start)
    size = np.diff(start)[of]
    own = np.concatenate([[0], np.cumsum(size)])
    x = data[np.repeat(start[of] - own[:-1], size) + np.arange(own[-1])]
    lat = lattices(v, x, own)
    n_units = len(start) - 1
    # In the order of their texts, units look up places close to each other.
    who = np.argsort(number * n_units + np.arange(n_units))
    node, got, draw = lat.last[number[who]], [], 0
    while len(who):
        e = np.searchsorted(lat.key, node + uniform(salt[who], draw) * (1 - 1e-9), "right")
        e = np.minimum(np.maximum(e, lat.first[node]), lat.first[node + 1] - 1)
        got.append((who, lat.piece[e]))
        node = lat.back[e]
        on = node >= 0
        who, node = who[on], node[on]
        draw += 1
    # Pieces are drawn from the end of each unit: the draw of number d is the d-th from its end.
    n = np.zeros(n_units, np.int64)
    for w, _ in got:
        n[w] += 1
    end = np.cumsum(n)
    ids = np.empty(end[-1], np.int64)
    for d, (w, p) in enumerate(got):
        ids[end[w] - 1 - d] = p
    return ids, n


def uniform_draws(key: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """uniform() of one key for several draws."""
    return (K.mix(key + (draws.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def key_number(v: Any) -> int:
    """A whole number as it is, any other key by a digest of all its text."""
    if v is None:
        return 0x5EED
    return v & ((1 << 64) - 1) if isinstance(v, int) else int.from_bytes(hashlib.blake2b(str(v).encode(), digest_size=8).digest(), "little")


def row_key(values: list, seed: int) -> np.ndarray:
    x = np.array([key_number(v) for v in values], np.uint64)
    return K.mix(x * np.uint64(0x2545F4914F6CDD1D | 1) + np.uint64(seed))


def encoder(v: Vocabulary, seed: int):
    """A function from texts and row keys to lists of ids."""

    def run(texts: pa.Array, row_keys: pa.Array) -> pa.Array:
        data, at = K.utf8(texts)
        keys, null = row_key(row_keys.to_pylist(), seed), texts.is_null().to_pylist()
        parts, ends, total = [], [], 0
        for lo, hi in K.chunks(at, CHUNK):
            ids, first = sample(v, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], keys[lo:hi])
            parts.append(ids.astype(np.int32))
            ends += (first[:-1] + total).tolist()
            total += len(ids)
        ends = [None if x else e for x, e in zip(null, ends)] + [total]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], pa.int32()))

    return run


def decoder(v: Vocabulary):
    """A function from lists of ids to texts."""
    size = np.array([len(t) for t in v.texts], np.int64)
    first = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(v.texts), np.uint8)

    def run(lists: pa.Array) -> pa.Array:
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.array([0 if k is None else k for k in lists.value_lengths().to_pylist()], np.int64)
        ids_at, valid, out = np.concatenate([[0], np.cumsum(n)]), lists.is_valid().to_pylist(), []
        for lo, hi in K.chunks(ids_at, CHUNK // 4):
            y = x[ids_at[lo] : ids_at[hi]]
            wide = size[y]
            end = np.concatenate([[0], np.cumsum(wide)])
            text = flat[np.repeat(first[y] - end[:-1], wide) + np.arange(end[-1])].tobytes()
            at = end[ids_at[lo : hi + 1] - ids_at[lo]].tolist()
            out += [text[a:b].decode("utf-8") if ok else None for a, b, ok in zip(at[:-1], at[1:], valid[lo:hi])]
        return pa.array(out, pa.string())

    return run


IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, key: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """docs with piece_ids, a sampled segmentation of text."""
    sent = docs.sparkSession.sparkContext.broadcast(load(s))
    text_at, key_at, seed = docs.columns.index("text"), docs.columns.index(key), s.seed

    def make():
        run = encoder(sent.value, seed)
        return lambda batch: {"piece_ids": run(batch.column(text_at), batch.column(key_at))}

    return map_texts(docs, [("piece_ids", IDS)], make)


def decode(df: DataFrame, ids: str = "piece_ids", name: str = "decoded", s: Settings = Settings()) -> DataFrame:
    """df with the text of its ids."""
    sent, ids_at = df.sparkSession.sparkContext.broadcast(load(s)), df.columns.index(ids)

    def make():
        run = decoder(sent.value)
        return lambda batch: {name: run(batch.column(ids_at))}

    return map_texts(df, [(name, T.StringType())], make)


def round_trip(docs: DataFrame, key: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """docs with piece_ids and decoded, both made by one Python worker: two steps in turn would take two for each task."""
    sent = docs.sparkSession.sparkContext.broadcast(load(s))
    text_at, key_at, seed = docs.columns.index("text"), docs.columns.index(key), s.seed

    def make():
        to_ids, to_text = encoder(sent.value, seed), decoder(sent.value)

        def f(batch):
            ids = to_ids(batch.column(text_at), batch.column(key_at))
            return {"piece_ids": ids, "decoded": to_text(ids)}

        return f

    return map_texts(docs, [("piece_ids", IDS), ("decoded", T.StringType())], make)


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per document its sampled ids, their number, the decoded text's digest, and whether it is the text."""
    both = round_trip(docs.select("doc_id", "text"), s=s)
    return both.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))
