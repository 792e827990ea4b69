"""Language identification by cross-parsing entropy.

A suffix automaton is built of a bounded sample of labelled text for each language. A text is cross-parsed with each: from where
the last phrase ended, the longest match in the language's text is the next phrase. Phrases times the logarithm of the sample's
length, over the length of the text, estimate its cross entropy; the language with the least wins, ties by name.

Texts are read as bytes: A-Z and the capitals of Latin-1 are lower-cased, and each run of bytes that are neither letters nor
outside ASCII becomes one symbol. The sample is whole documents: of the first 4 * docs_per_language by a hash of doc_id, those of an eighth of
bytes_per_language or less, as many as docs_per_language and bytes_per_language allow; without any of these the shortest.

Whole texts are parsed. For speed, all parts of SEGMENT symbols of all texts are parsed at once, each from the automaton's start; then
every part is parsed again from the state in which the part before it ended, until no such state changes any more. Two parses that once
end a phrase at one place agree from there on, so that takes two or three rounds; the phrases are those of a parse from the text's start.

A null text, or one without any letter, gets lang_pred 'und' and score 0, as does every text where no labelled text was found.
The score is the share of the winner among exp(-SHARPNESS * relative excess of its entropy); 1 with a single language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import held_out, map_texts

SEGMENT = 256
SHARPNESS = 20.0
UNDETERMINED = "und"
#: Documents that are looked at for each one that is learned from.
CANDIDATES = 4
#: A short document takes no more than this part of its language's sample.
SHARE = 8
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    #: Labelled documents learned from for each language at most.
    docs_per_language: int = 64
    #: Bytes of them at most; a language whose shortest labelled document is longer learns from that one.
    bytes_per_language: int = 32_768


@dataclass(frozen=True)
class Model:
    """names: the languages, sorted; samples: the symbols of each, as bytes."""

    names: tuple[str, ...]
    samples: tuple[bytes, ...]


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each row: letters, bytes outside ASCII, and 32 for each run of others."""
    x = K.LOWER[data]
    if len(x) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        x[capital] += 0x20
    x[(x < 97) | ((x > 122) & (x < 128))] = 32
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[at[:-1][at[:-1] < len(x)]] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def automaton(text: bytes) -> tuple[list[dict[int, int]], int]:
    """The suffix automaton of text: each state's transitions; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def table(text: bytes, alphabet: np.ndarray, n: int) -> np.ndarray:
    """For state * n + symbol: twice the next state * n, plus 1 where a phrase ends. The last symbol, padding, stays."""
    step = automaton(text)
    root = np.zeros(n, np.int64)
    for c, q in step[0].items():
        root[alphabet[c]] = q * n
    out = np.tile((root * 2 + 1).astype(np.int32), (len(step), 1))
    for i, t in enumerate(step):
        for c, q in t.items():
            out[i, alphabet[c]] = q * n * 2
    out[0] = root * 2 + (root == 0)
    out[:, n - 1] = np.arange(len(step)) * n * 2
    return out.ravel()


_tables: dict[Model, tuple] = {}


def tables(m: Model):
    """The tables of a model, made once in each Python worker."""
    if m not in _tables:
        seen = np.unique(np.frombuffer(b"".join(m.samples), np.uint8))
        n = len(seen) + 2
        alphabet = np.full(256, n - 2)
        alphabet[seen] = np.arange(len(seen))
        _tables.clear()
        _tables[m] = alphabet, n, [table(s, alphabet, n) for s in m.samples]
    return _tables[m]


def phrases(m: Model, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Phrases of each row of symbols by each language."""
    alphabet, n, parsed = tables(m)
    size = np.diff(at)
    lanes = -(-size // SEGMENT)
    lane_at = np.concatenate([[0], np.cumsum(lanes)])
    total = int(lane_at[-1])
    flat = np.full(total * SEGMENT, n - 1, np.int32)
    row = np.repeat(np.arange(len(size)), size)
    flat[lane_at[row] * SEGMENT + np.arange(len(x)) - at[row]] = alphabet[x]
    grid = np.ascontiguousarray(flat.reshape(total, SEGMENT).T)
    inner = np.ones(total, bool)
    inner[lane_at[:-1][lanes > 0]] = False
    inner = np.flatnonzero(inner)
    out = np.zeros((len(size), len(parsed)))
    for k, t in enumerate(parsed):
        began = np.zeros(total, np.int32)
        state, ends = parse_parts(t, grid, began)
        while len(again := inner[began[inner] != state[inner - 1]]):
            began[again] = state[again - 1]
            state[again], ends[again] = parse_parts(t, np.ascontiguousarray(grid[:, again]), began[again])
        # The last phrase ends with the text.
        out[:, k] = K.run_sums(ends.astype(np.int64), lane_at) + (size > 0)
    return out


def parse_parts(t: np.ndarray, grid: np.ndarray, began: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state at the end, phrases ended) of each column of symbols, parsed from its state in began."""
    state, ends = began, np.zeros(len(began), np.int32)
    for c in grid:
        v = t[state + c]
        ends += v & 1
        state = v >> 1
    return state, ends


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """A model from documents that have a language and are not held out."""
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # Candidates are chosen without their texts: of about twice as many as wanted, by a threshold of a hash, the first by that hash.
    most = CANDIDATES * s.docs_per_language
    place = F.xxhash64("doc_id").bitwiseAND((1 << 53) - 1) / float(1 << 53)
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"))
    near = known.join(F.broadcast(counts), "lang").filter(place * F.col("rows") < 2 * most + 64).select("doc_id", "lang", place.alias("place"))
    of_language = Window.partitionBy("lang")
    first = near.withColumn("n", F.row_number().over(of_language.orderBy("place", "doc_id"))).filter(F.col("n") <= most).select("doc_id", "lang", "place").distinct()
    # A few hundred rows for each language, now with their texts: short ones first, the shortest of the others last.
    size, short = F.octet_length("text"), s.bytes_per_language // SHARE
    rows = known.join(F.broadcast(first), ["doc_id", "lang"]).withColumns({"size": size, "long": F.when(size > short, size).otherwise(0)})
    rows = rows.dropDuplicates(["lang", "text"]).withColumn("n", F.row_number().over(of_language.orderBy("long", "place", "doc_id", "text")))
    rows = rows.filter((F.col("n") == 1) | (F.col("long") == 0)).filter(F.col("n") <= s.docs_per_language)
    sums = F.sum("size").over(of_language.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("sum", sums).filter((F.col("n") == 1) | (F.col("sum") <= s.bytes_per_language))
    rows = rows.select("lang", "n", "text").orderBy("lang", "n")
    held: dict[str, list[bytes]] = {}
    for r in rows.toLocalIterator():
        data, at = K.utf8(pa.array([r["text"]], pa.string()))
        held.setdefault(r["lang"], []).append(symbols(data, at)[0].tobytes() + b" ")
    names = tuple(sorted(held))
    return Model(names, tuple(b"".join(held[n]) for n in names))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    sent, text_at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def make():
        m = sent.value
        logs = np.log2([max(len(x), 2) for x in m.samples])

        def f(batch):
            data, at = K.utf8(batch.column(text_at))
            names, scores = [], []
            for lo, hi in K.chunks(at):
                texts = batch.column(text_at).slice(lo, hi - lo).to_pylist()
                ok = [bool(m.names) and t is not None and LETTER.search(t) is not None for t in texts]
                x, x_at = symbols(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                cost = phrases(m, x, x_at) * logs if m.names else np.zeros((hi - lo, 0))
                for good, c in zip(ok, cost):
                    if good:
                        best = int(np.argmin(c))
                        names.append(m.names[best])
                        scores.append(round(float(1 / np.exp(-SHARPNESS * (c / c[best] - 1)).sum()), 9))
                    else:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
            return {"lang_pred": names, "score": scores}

        return f

    return map_texts(docs, [("lang_pred", T.StringType()), ("score", T.DoubleType())], make)


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return identify(docs.select("doc_id", "text"), train(docs, s)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
