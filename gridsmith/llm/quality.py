"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are counts of hashed lower-cased words and word pairs, and of n-grams of word shapes (runs of upper-case letters,
lower-case letters and digits each become one symbol; other bytes stay), and whether a word repeats the one before it,
divided by the square root of their number.
A null or empty text has no features and gets the score of the bias alone. Without labels every score is 0.5.
Rows with a null doc_id are scored and are not held out; repeated rows are each scored; other columns are kept by score().
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import held_out, map_texts

NOT_SPACE = ~K.SPACE
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[48:58], SHAPE[65:91], SHAPE[97:123], SHAPE[128:] = ord("9"), ord("A"), ord("a"), ord("a")
RUNS = np.isin(np.arange(256), [ord("9"), ord("A"), ord("a")])
SAME = np.arange(256, dtype=np.uint8)


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: At most so many labelled rows, the first by a hash of doc_id, are learned from.
    most_labelled: int = 8_000
    #: Of these, rows with texts of more bytes are not learned from; all rows are scored.
    most_bytes: int = 1 << 16
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each row, in no order and with repeats, and each row's first."""
    h, _, _, first = K.words(data, at, NOT_SPACE)
    shape = SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~RUNS[shape[1:]]
    keep[at[:-1][at[:-1] < len(data)]] = True
    kept_at = np.concatenate([[0], np.cumsum(keep)])[at]
    s, _, _, s_first = K.words(shape[keep], kept_at, NOT_SPACE, SAME)
    parts = []
    for salt, (g, n, f) in enumerate(((h, 1, first), (h, 2, first), (s, 1, s_first), (s, 2, s_first), (s, 3, s_first))):
        x, x_at = K.ngrams(g, f, n)
        parts.append(((K.mix(x + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64), x_at))
    pair, pair_at = K.ngrams(h, first, 2)
    pos = np.repeat(first[:-1] - pair_at[:-1], np.diff(pair_at)) + np.arange(len(pair))
    twice = h[pos] == h[pos + 1] if len(pos) else np.zeros(0, bool)
    parts.append((twice.astype(np.int64), pair_at))
    row_at = sum(x_at for _, x_at in parts)
    out = np.empty(row_at[-1], np.int64)
    before = row_at[:-1].copy()
    for x, x_at in parts:
        n = np.diff(x_at)
        out[np.repeat(before - x_at[:-1], n) + np.arange(len(x))] = x
        before += n
    return out, row_at


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> Model:
    """rows: (feature numbers, values, label 0 or 1); the order of rows is the order of learning."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)
    bias = 1 << s.bits
    ones = sum(y for _, _, y in rows)
    # Both labels weigh the same in all, so that a rare one is not learned as noise.
    weight = [len(rows) / (2 * max(k, 1)) for k in (len(rows) - ones, ones)]

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)
        return np.where(np.abs(zi) <= s.l1, 0.0, w)

    for _ in range(s.epochs):
        for at, x, y in rows:
            at, x = np.append(at, bias), np.append(x, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight[y] * (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """A model from the labelled rows that are not held out; at most s.most_labelled of them."""
    spark = docs.sparkSession
    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg((F.max("quality") > 0).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(s.most_labelled)
        .collect()
    )
    if not picked:
        return Model(np.zeros(1 << s.bits, np.float32), 0.0)
    kind = docs.schema["doc_id"].dataType
    few = spark.createDataFrame([(r["_id"], r["_y"]) for r in picked], T.StructType([T.StructField("_id", kind), T.StructField("_y", T.IntegerType())]))
    texts = docs.select(F.col("doc_id").alias("_id"), "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= s.most_bytes).join(F.broadcast(few), "_id").select("_id", "_y", "text")
    bits = s.bits

    def make():
        def f(batch):
            at_, val = [], []
            data, at = K.utf8(batch.column(2))
            for lo, hi in K.chunks(at):
                x, x_at = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                for a, b in zip(x_at[:-1], x_at[1:]):
                    u, c = np.unique(x[a:b], return_counts=True)
                    at_.append(u.astype(np.int32).tobytes())
                    val.append((c / np.sqrt(max(b - a, 1))).astype(np.float32).tobytes())
            return {"at": pa.array(at_, pa.binary()), "x": pa.array(val, pa.binary()), "text": pa.nulls(batch.num_rows, pa.string())}

        return f

    got = map_texts(texts, [("text", T.StringType()), ("at", T.BinaryType()), ("x", T.BinaryType())], make).select("_id", "_y", "at", "x")
    seen = sorted({(r["_id"], r["_y"], bytes(r["at"]), bytes(r["x"])) for r in got.toLocalIterator()}, key=lambda r: (hash_id(r[0]), r))
    return fit([(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32).astype(float), y) for _, y, at, x in seen], s)


def hash_id(x) -> int:
    return int(K.mix(np.array([abs(int(x)) % (1 << 63)], np.uint64))[0]) if isinstance(x, int) else 0


def score(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 is likelier) and predicted (1 from s.threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    bits, threshold, column = s.bits, s.threshold, docs.columns.index("text")

    def make():
        weights, bias = shared.value

        def f(batch):
            data, at = K.utf8(batch.column(column))
            out = np.empty(batch.num_rows)
            for lo, hi in K.chunks(at):
                x, x_at = features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], bits)
                out[lo:hi] = bias + K.run_sums(weights[x].astype(float), x_at) / np.sqrt(np.maximum(np.diff(x_at), 1))
            p = np.round(1 / (1 + np.exp(-np.clip(out, -35, 35))), 9)
            return {"score": pa.array(p), "predicted": pa.array((p >= threshold).astype(np.int32))}

        return f

    return map_texts(docs, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def query(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return score(docs, train(docs, labels, s), s).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
