"""Language-model scores by stupid backoff, computed relationally over the corpus itself.

Words are runs between ASCII white space, A-Z lower-cased. All counts are over all rows of the table. A word w that follows v in
its row has the score c(v w) / c(v) if the pair occurs in any other row too, else BACKOFF * c(w) / N; the first word of a row
has c(w) / N. N counts all words, c(v) all occurrences of v. logp sums the natural logarithms for each document and perplexity
is exp(-logp / n_words).

Pairs are dealt to shards by a hash of their first word, packed: a block of texts sends each shard one row of arrays of its distinct
pairs, their counts, and the 16-bit numbers of the texts that hold them. A shard counts pairs and first words, joins the counts
to the pairs, and sends on a sum for each text, the words that back off, and its counts of words, now dealt by a hash of
the word in one row for each other shard, where the counts of words are joined to them. Sums of a block meet at last and are joined to
the rows by a digest of the text. First words that occur more often than a shard is large, and the place before a first word, are dealt by
a hash of the pair; the counts of such words, fewer than there are shards, are sent to all tasks, so nobody is asked for them either.
Which words are so treated is counted over all rows and changes no result.

Words are told apart by hashes of 48 bits. A null or empty text has n_words 0, logp 0 and a null perplexity. Rows of equal texts
count as rows of their own and have equal scores. Other columns are kept; columns of the names added are replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import arrow_map, fresh, map_texts, slices, tidy_group

NOT_SPACE = ~K.SPACE
BACKOFF = 0.4
#: Texts of a block at most; their numbers within it have 16 bits.
BLOCK = 1 << 14
BLOCK_BYTES = 16 << 20
LOW48 = np.uint64((1 << 48) - 1)
BEFORE, BEHIND = 0, (1 << 48) - 1
#: Scores of a shard that are held before they are summed for each text.
SUMMED = 1 << 20
MOST_PARTITIONS = 50_000


@dataclass(frozen=True)
class Settings:
    #: Word pairs of a shard, about.
    shard_pairs: int = 1_800_000


def text_key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def words48(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, first = [], [np.zeros(1, np.int64)]
    for lo, hi in K.chunks(at):
        x, _, _, f = K.words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], NOT_SPACE)
        h.append(x)
        first.append(f[1:] + first[-1][-1])
    h = np.concatenate(h) & LOW48 if h else np.zeros(0, np.uint64)
    return np.where((h == BEFORE) | (h == BEHIND), np.uint64(1), h), np.concatenate(first)


def pack(x: np.ndarray) -> bytes:
    """48-bit numbers, 6 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel().astype(np.uint64)


def deal(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def totals(docs: DataFrame, s: Settings) -> tuple[int, np.ndarray, np.ndarray]:
    """(N, the words that occur more often than shard_pairs, their counts), counted over all rows."""

    def count(batches):
        for batch in batches:
            for part in slices(batch, BLOCK_BYTES):
                h, _ = words48(*K.utf8(part.column(0)))
                u, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(u.view(np.int64), -1)), pa.array(np.append(n, len(h)))], ["word", "n"])

    counts = docs.select("text").transform(arrow_map, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Fewer words than there are shards can be that frequent.
    found = {r["word"]: r["n"] for r in counts.filter((F.col("word") == -1) | (F.col("n") > s.shard_pairs)).collect()}
    total = found.pop(-1, 0)
    often = np.array(sorted(found), np.int64)
    return total, often.view(np.uint64), np.array([found[w] for w in often.tolist()], np.float64)


PAIRS = [("shard", pa.int32()), ("block", pa.binary()), ("keys", pa.binary()), ("firsts", pa.binary()), ("sizes", pa.binary()), ("seconds", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary())]
PAIRS_SCHEMA = "shard int, block binary, keys binary, firsts binary, sizes binary, seconds binary, counts binary, docs binary"
WORDS = [("shard", pa.int32()), *((n, pa.binary()) for n in ("block", "keys", "docs", "sums", "asked", "asked_docs", "asked_blocks", "asked_sizes", "words", "counts"))]
WORDS_SCHEMA = "shard int, block binary, keys binary, docs binary, sums binary, asked binary, asked_docs binary, asked_blocks binary, asked_sizes binary, words binary, counts binary"
SUMS = [(n, pa.binary()) for n in ("block", "keys", "docs", "sums")]
SUMS_SCHEMA = "block binary, keys binary, docs binary, sums binary"


def batch_of(rows: list[tuple], columns) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, columns)], [n for n, _ in columns])


def pair_blocks(docs: DataFrame, shards: int, often: np.ndarray) -> DataFrame:
    """Rows of arrays for each block and shard: first words and how many pairs each has, second words, counts and texts."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(np.append(often, np.uint64(BEFORE))))

    def blocks(batches):
        """Batches put together to blocks of about BLOCK_BYTES."""
        held, size, rows = [], 0, 0
        for batch in batches:
            for part in slices(batch, BLOCK_BYTES // 4):
                if held and (size + part.nbytes > BLOCK_BYTES or rows + part.num_rows > BLOCK):
                    yield pa.Table.from_batches(held)
                    held, size, rows = [], 0, 0
                held.append(part)
                size, rows = size + part.nbytes, rows + part.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        spread = sent.value
        for table in blocks(batches):
            for part in (table.slice(lo, BLOCK) for lo in range(0, table.num_rows, BLOCK)):
                if part.num_rows:
                    data, at = K.utf8(part.column(0))
                    keys = b"".join(text_key(data[i:j]) for i, j in zip(at[:-1], at[1:]))
                    block = hashlib.blake2b(keys, digest_size=16).digest()
                    h, first = words48(data, at)
                    n = np.diff(first)
                    full = np.flatnonzero(n)
                    # One pair more than words: from the place before to the place behind the row.
                    size = np.where(n > 0, n + 1, 0)
                    end = np.cumsum(size)[full]
                    a, b = np.empty(int(size.sum()), np.uint64), np.empty(int(size.sum()), np.uint64)
                    doc = np.repeat(np.arange(len(n)), size)
                    heads = np.zeros(len(a), bool)
                    heads[end - size[full]] = True
                    tails = np.zeros(len(a), bool)
                    tails[end - 1] = True
                    a[heads], a[~heads] = BEFORE, h
                    b[tails], b[~tails] = BEHIND, h
                    i = np.minimum(np.searchsorted(spread, a), len(spread) - 1)
                    by = K.mix(np.where(spread[i] == a, a ^ K.mix(b), a))
                    order = np.lexsort((b, by))
                    a, b, doc, shard = a[order], b[order], doc[order], deal(by[order], shards)
                    edge = np.append(starts(shard), len(a)) if len(a) else np.zeros(1, np.int64)
                    rows = [(int.from_bytes(block[:4], "little") % shards, block, keys, *[b""] * 5)]
                    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                        pair = starts(a[i:j], b[i:j])
                        pa_, pb = a[i:j][pair], b[i:j][pair]
                        group = starts(pa_)
                        rows.append(
                            (
                                int(shard[i]),
                                block,
                                None,
                                pack(pa_[group]),
                                zlib.compress(np.diff(np.append(group, len(pa_))).astype(np.uint32).tobytes(), 1),
                                pack(pb),
                                zlib.compress(np.diff(np.append(pair, j - i)).astype(np.uint32).tobytes(), 1),
                                doc[i:j].astype(np.uint16).tobytes(),
                            )
                        )
                    yield batch_of(rows, PAIRS)

    return docs.select("text").transform(arrow_map, run, PAIRS_SCHEMA)


def look_up(keys: np.ndarray, values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each x is one of the ascending keys, its value or 0)."""
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x))
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    there = keys[i] == x
    return there, np.where(there, values[i], 0.0)


def runs_of(x: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of runs of equal values."""
    edge = np.append(starts(x), len(x)) if len(x) else np.zeros(1, np.int64)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


def join_pairs(shards: int, total: int, often: np.ndarray, often_counts: np.ndarray):
    """From a shard's pairs to sums of what is known here, words that back off, and counts of words.

    Known are pairs that other rows have too, and words that occur so often that their counts were sent to all tasks.
    Another shard gets one row of all that it is asked for and told.
    """

    def home(block: bytes) -> int:
        return int.from_bytes(block[:4], "little") % shards

    def run(table: pa.Table) -> pa.Table:
        out: list[dict] = []
        first, second, doc = [], [], []
        blocks: list[bytes] = []
        for r in table.to_pylist():
            if r["keys"] is not None:
                out.append({"shard": home(r["block"]), "block": r["block"], "keys": r["keys"], "docs": b"", "sums": b""})
                continue
            sizes, counts = (np.frombuffer(zlib.decompress(r[c]), np.uint32) for c in ("sizes", "counts"))
            first.append(np.repeat(np.repeat(unpack(r["firsts"]), sizes), counts))
            second.append(np.repeat(unpack(r["seconds"]), counts))
            doc.append(np.frombuffer(r["docs"], np.uint16).astype(np.int64) + len(blocks) * 65536)
            blocks.append(r["block"])
        if blocks:
            first, second, doc = (np.concatenate(x) for x in (first, second, doc))
            order = np.lexsort((second, first))
            first, second, doc = first[order], second[order], doc[order]
            pair, context = starts(first, second), starts(first)
            c_pair = np.diff(np.append(pair, len(first)))
            c_first = np.diff(np.append(context, len(first))).astype(np.float64)
            seen = np.minimum.reduceat(doc, pair) != np.maximum.reduceat(doc, pair)
            words, counts = first[context], c_first.astype(np.int64)
            frequent, known = look_up(often, often_counts, words)
            c_first = np.where(frequent, known, c_first)
            ratio = np.log(c_pair / np.repeat(c_first, np.diff(np.append(np.searchsorted(pair, context), len(pair)))))
            head, scored = first == BEFORE, second != BEHIND
            found = np.repeat(seen, c_pair) & scored & ~head
            back = scored & ~found
            frequent, known = look_up(often, np.log(BACKOFF * often_counts / max(total, 1)), second)
            score = np.where(found, np.repeat(np.where(seen, ratio, 0.0), c_pair), known)
            # The first word of a row takes no factor.
            score = np.where(head, score - math.log(BACKOFF), score)
            use = scored & (found | head | frequent)
            who, number = np.unique(doc[use], return_inverse=True)
            sums = np.bincount(number, score[use], len(who))
            for i, j in runs_of(who >> 16):
                b = blocks[int(who[i] >> 16)]
                out.append({"shard": home(b), "block": b, "docs": (who[i:j] & 65535).astype(np.uint16).tobytes(), "sums": sums[i:j].tobytes()})

            to: dict[int, dict] = {}
            back &= ~frequent
            w, d = second[back], doc[back]
            where = deal(K.mix(w), shards)
            order = np.lexsort((d, where))
            w, d, where = w[order], d[order], where[order]
            for i, j in runs_of(where):
                own = runs_of(d[i:j] >> 16)
                to[int(where[i])] = {
                    "asked": pack(w[i:j]),
                    "asked_docs": (d[i:j] & 65535).astype(np.uint16).tobytes(),
                    "asked_blocks": b"".join(blocks[int(d[i + a] >> 16)] for a, _ in own),
                    "asked_sizes": np.array([b - a for a, b in own], np.uint32).tobytes(),
                }
            real = words != BEFORE
            words, counts = words[real], counts[real]
            where = deal(K.mix(words), shards)
            order = np.argsort(where, kind="stable")
            words, counts, where = words[order], counts[order], where[order]
            for i, j in runs_of(where):
                to.setdefault(int(where[i]), {}).update(words=pack(words[i:j]), counts=zlib.compress(counts[i:j].tobytes(), 1))
            out += [{"shard": k, **r} for k, r in to.items()]
        return pa.Table.from_batches([batch_of([tuple(r.get(n) for n, _ in WORDS) for r in out], WORDS)])

    return run


def join_words(total: int):
    """From a shard's counts of words and its words that back off to sums for texts; other sums and keys are passed on."""

    def run(table: pa.Table) -> pa.Table:
        out, words, counts, asks = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for r in table.to_pylist():
            if r["block"] is not None:
                out.append((r["block"], r["keys"], r["docs"], r["sums"]))
            if r["counts"] is not None:
                words.append(unpack(r["words"]))
                counts.append(np.frombuffer(zlib.decompress(r["counts"]), np.int64))
            if r["asked"] is not None:
                asks.append(r)
        u, which = np.unique(np.concatenate(words), return_inverse=True)
        logs = np.log(BACKOFF * np.bincount(which, np.concatenate(counts), len(u)) / max(total, 1))
        number: dict[bytes, int] = {}
        keys, values, held = [], [], 0
        for k, r in enumerate(asks):
            blocks = [number.setdefault(r["asked_blocks"][i : i + 16], len(number)) for i in range(0, len(r["asked_blocks"]), 16)]
            of = np.repeat(np.array(blocks, np.int64) << 16, np.frombuffer(r["asked_sizes"], np.uint32))
            keys.append(of | np.frombuffer(r["asked_docs"], np.uint16))
            values.append(logs[np.searchsorted(u, unpack(r["asked"]))])
            held += len(of)
            if held > SUMMED or k + 1 == len(asks):
                who, place = np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.bincount(place, np.concatenate(values), len(who))
                # What is summed so far counts half, so that it is sorted again seldom.
                keys, values, held = [who], [sums], len(who) // 2
        who, sums = (keys[0], values[0]) if asks else (np.zeros(0, np.int64), np.zeros(0))
        names = list(number)
        out += [(names[int(who[i] >> 16)], None, (who[i:j] & 65535).astype(np.uint16).tobytes(), sums[i:j].tobytes()) for i, j in runs_of(who >> 16)]
        return pa.Table.from_batches([batch_of(out, SUMS)])

    return run


def sum_block(table: pa.Table) -> pa.Table:
    """From a block's sums to (text_key, logp). Equal blocks send equal sums again, which the number of their keys tells."""
    rows = table.to_pylist()
    keys = [r["keys"] for r in rows if r["keys"] is not None]
    logp = np.zeros(len(keys[0]) // 16)
    for r in rows:
        np.add.at(logp, np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["sums"], np.float64))
    return pa.table({"text_key": pa.array([keys[0][i : i + 16] for i in range(0, len(keys[0]), 16)], pa.binary()), "logp": pa.array(logp / len(keys))})


def scores(docs: DataFrame, s: Settings) -> DataFrame:
    """(text_key, logp) of each distinct text."""
    total, often, often_counts = totals(docs, s)
    shards = max(1, math.ceil(total / s.shard_pairs))
    # As many partitions as shards, so that tasks stay as large as they are when the corpus grows.
    parts = min(shards, MOST_PARTITIONS)
    pairs = pair_blocks(docs, shards, often).repartition(parts, "shard").groupBy("shard").applyInArrow(tidy_group(join_pairs(shards, total, often, often_counts)), WORDS_SCHEMA)
    sums = pairs.repartition(parts, "shard").groupBy("shard").applyInArrow(tidy_group(join_words(total)), SUMS_SCHEMA)
    sums = sums.repartition(parts, "block").groupBy("block").applyInArrow(tidy_group(sum_block), "text_key binary, logp double")
    return sums.groupBy("text_key").agg(F.min("logp").alias("logp"))


def score(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with n_words, logp and perplexity."""
    docs = docs.drop("n_words", "logp", "perplexity")
    columns, text_at = docs.columns, docs.columns.index("text")
    (key,) = fresh(docs, "key")

    def keyed():
        def f(batch):
            data, at = K.utf8(batch.column(text_at))
            return {key: pa.array([text_key(data[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()), "n_words": pa.array(np.diff(words48(data, at)[1]))}

        return f

    rows = map_texts(docs, [(key, T.BinaryType()), ("n_words", T.LongType())], keyed)
    found = rows.join(scores(docs.select("text"), s).withColumnRenamed("text_key", key), key, "left")
    logp = F.coalesce("logp", F.lit(0.0))
    return found.select(*columns, "n_words", logp.alias("logp"), F.when(F.col("n_words") > 0, F.exp(-logp / F.col("n_words"))).alias("perplexity"))


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return score(docs.select("doc_id", "text"), s).select("doc_id", "n_words", F.round("logp", 4).alias("logp"), F.round("perplexity", 3).alias("perplexity"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), t AS (SELECT r, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), u AS (SELECT b, count(*) AS c FROM t GROUP BY b
), p AS (SELECT a, b, count(*) AS c, min(r) <> max(r) AS seen FROM t WHERE a IS NOT NULL GROUP BY a, b
), n AS (SELECT count(*) AS n FROM t
), s AS (
  SELECT t.r, CASE WHEN t.a IS NULL THEN ln(ub.c::DOUBLE / n.n) WHEN p.seen THEN ln(p.c::DOUBLE / ua.c) ELSE ln(0.4 * ub.c / n.n) END AS x
  FROM t CROSS JOIN n JOIN u ub ON ub.b = t.b LEFT JOIN u ua ON ua.b = t.a LEFT JOIN p ON p.a = t.a AND p.b = t.b
), g AS (SELECT r, sum(x) AS logp FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(logp, 0), 4) AS logp, CASE WHEN len(w) > 0 THEN round(exp(-logp / len(w)), 3) END AS perplexity
FROM d LEFT JOIN g USING (r)
"""
