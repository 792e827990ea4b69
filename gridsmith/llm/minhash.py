"""MinHash near-dedup: universal hash minima, banding, verification on full sets, connected components.

A document's set is its distinct shingles of `shingle` consecutive words (runs between ASCII white space, A-Z lower-cased); a
text of fewer words, but not none, is one shingle. Documents of equal sets are one class from the start. Two classes are linked
if percent * union <= 100 * intersection. Each class's signature has bands * rows minima of universal hashes; classes
with an equal band share a bucket.

Links are found in two rounds. First each class is compared with one class only: of the least members of its buckets, the one
with which it shares most. The links found join classes into groups. Then, in buckets that still hold several groups, all pairs
of classes of different groups are compared by signature, in blocks of `block` members, and those that may be linked on their
full sets. Pairs within a group need no comparison, as they can't change it, so no pair that shares a bucket is left out. Of buckets
of up to `small` classes, the pairs to verify are joined to their sets. To larger buckets the sets are brought instead: a task
verifies a block against a block, joins groups as it goes, and gives out the links that join groups, at most one for each class.

A null text, or one without words, has no set: n_shingles 0, component_id its doc_id, kept. Rows of one doc_id with other texts
are told apart by their sets. A row with a null doc_id takes part, but isn't kept where its group has an id; a group without
any id has a null component_id, and its rows are kept. Other columns are kept; those with the names added are replaced.
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
from .common import arrow_map, aside, drop_tables, let_go, map_texts, slices, tidy_group, write_table
from .components import components
from .line_dedup import has, put

NOT_SPACE = ~K.SPACE


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    percent: int = 85
    #: Links are found by bands, not exactly: of pairs of likeness 0.85, 4e-7 share no band, of 0.8 5e-5; more bands miss fewer.
    bands: int = 25
    rows: int = 5
    #: Signatures whose likeness is below the threshold by so many standard deviations are not verified.
    deviations: float = 5.0
    block: int = 4_096
    small: int = 16
    #: Size of the filter that tells which documents' sets are needed; it spares work and decides nothing.
    filter_bytes: int = 8 << 20


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n universal hashes x -> (a * x + b) mod 2**64, of which the high 32 bits count."""
    r = np.random.default_rng(7)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)


def sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, ascending, and each row's first."""
    h, _, _, first = K.words(data, at, NOT_SPACE)
    x, x_at = K.ngrams(h, first, n, whole=True)
    row = np.repeat(np.arange(len(at) - 1), np.diff(x_at))
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    x, row = x[new], row[new]
    return x, np.searchsorted(row, np.arange(len(at)))


def set_key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, s: Settings, minima: bool) -> DataFrame:
    """docs with __n (shingles), __set (a digest of the set, null without one) and, if minima, __sig."""
    text_at, n, width = docs.columns.index("text"), s.shingle, s.bands * s.rows

    def make():
        a, b = hash_family(width)

        def f(batch):
            data, at = K.utf8(batch.column(text_at))
            size, keys, sigs = [], [], []
            for lo, hi in K.chunks(at, 1 << 19):
                x, x_at = sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n)
                m = np.diff(x_at)
                size.append(m)
                full = np.flatnonzero(m)
                keys += [set_key(x[i:j]) if j > i else None for i, j in zip(x_at[:-1].tolist(), x_at[1:].tolist())]
                if minima:
                    sig = np.zeros((len(m), width), np.uint32)
                    if len(full):
                        for k in range(width):
                            sig[full, k] = np.minimum.reduceat((x * a[k] + b[k]) >> np.uint64(32), x_at[:-1][full])
                    sigs += [r.tobytes() if c else None for r, c in zip(sig, m.tolist())]
            out = {"__n": pa.array(np.concatenate(size) if size else np.zeros(0, np.int64)), "__set": pa.array(keys, pa.binary())}
            return out | ({"__sig": pa.array(sigs, pa.binary())} if minima else {})

        return f

    added = [("__n", T.LongType()), ("__set", T.BinaryType())]
    return map_texts(docs, added + [("__sig", T.BinaryType())] * minima, make)


def buckets(classes: DataFrame, s: Settings) -> DataFrame:
    """(bucket, node): the buckets of each class, for (node, _sig)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, s.bands, s.rows).astype(np.uint64)
            h = np.zeros(sig.shape[:2], np.uint64) + np.arange(s.bands, dtype=np.uint64)
            for r in range(s.rows):
                h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), s.bands)))], ["bucket", "node"])

    return classes.select("node", "_sig").transform(arrow_map, run, "bucket long, node binary")


def needed_sets(docs: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    """(node, items) of the given (node, doc_id), where doc_id has the set of the class."""
    bits = np.zeros(s.filter_bytes, np.uint8)

    def codes(keys: list, ids: list) -> np.ndarray:
        return np.array([int.from_bytes(hashlib.blake2b(k + repr(i).encode(), digest_size=8).digest(), "little") for k, i in zip(keys, ids)], np.uint64)

    def run(batches):
        own = np.zeros(len(bits), np.uint8)
        for batch in batches:
            put(own, codes(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        block = 1 << 16
        rows = [(i, own[i : i + block].tobytes()) for i in range(0, len(own), block) if own[i : i + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["at", "bits"])

    # Tasks send filters, which have a fixed size, not the classes themselves.
    for r in nodes.select("node", "doc_id").coalesce(16).transform(arrow_map, run, "at long, bits binary").toLocalIterator():
        bits[r["at"] : r["at"] + len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    sent, n = docs.sparkSession.sparkContext.broadcast(bits), s.shingle

    def pick(batches):
        for batch in batches:
            for part in slices(batch):
                data, at = K.utf8(part.column(1))
                ids = part.column(0).to_pylist()
                for lo, hi in K.chunks(at):
                    x, x_at = sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], n)
                    rows = np.flatnonzero(np.diff(x_at))
                    if not len(rows):
                        continue
                    keys = [set_key(x[x_at[r] : x_at[r + 1]]) for r in rows]
                    found = np.flatnonzero(has(sent.value, codes(keys, [ids[lo + r] for r in rows])))
                    yield pa.RecordBatch.from_arrays([pa.array([keys[k] for k in found], pa.binary()), pa.array([x[x_at[rows[k]] : x_at[rows[k] + 1]].tobytes() for k in found], pa.binary())], ["node", "items"])

    got = docs.select("doc_id", "text").transform(arrow_map, pick, "node binary, items binary")
    return got.groupBy("node").agg(F.first("items").alias("items"))


def verify(pairs: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    percent = s.percent

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    joined = pairs.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return joined.select("a", "b", "x", "y").transform(arrow_map, run, "a binary, b binary")


def least_likeness(s: Settings) -> float:
    t = s.percent / 100
    return t - s.deviations * math.sqrt(t * (1 - t) / (s.bands * s.rows))


def small_pairs(members: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of different groups in one small bucket whose signatures may be of linked classes, for (bucket, node, root, _sig)."""
    least = least_likeness(s)

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["_sig"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        node, root = table["node"].to_pylist(), table["root"].to_pylist()
        pairs = [(max(node[p], node[q]), min(node[p], node[q])) for p in range(len(node)) for q in range(p) if root[p] != root[q] and (sig[p] == sig[q]).mean() >= least]
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.binary()), "b": pa.array([x for _, x in pairs], pa.binary())})

    return members.groupBy("bucket").applyInArrow(run, "a binary, b binary").distinct()


def block_links(members: DataFrame, items: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that join groups in large buckets, for (bucket, node, root, _sig, n: the bucket's size)."""
    least, percent = least_likeness(s), s.percent
    blocks = F.ceil(F.col("n") / s.block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("c")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    dealt = members.withColumn("c", blocks).withColumn("own", own).withColumn("cell", F.explode(cells)).join(items, "node").select("bucket", "cell.i", "cell.j", "own", "node", "root", "_sig", "items")

    def run(table: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(table["_sig"].to_pylist()), np.uint32).reshape(table.num_rows, -1)
        node, own = table["node"].to_pylist(), np.array(table["own"].to_pylist())
        _, group = np.unique(np.array([r.hex() for r in table["root"].to_pylist()]), return_inverse=True)
        parts = [np.frombuffer(x, np.uint64) for x in table["items"].to_pylist()]
        size = np.array([len(x) for x in parts])
        at, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(parts)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for p in left.tolist():
            q = right[(group[right] != group[p]) & ((right > p) if i == j else True)]
            q = q[(sig[q] == sig[p]).mean(axis=1) >= least] if len(q) else q
            # The likeliest first, in growing runs: most classes are joined by the first.
            q = q[np.argsort(-(sig[q] == sig[p]).sum(axis=1), kind="stable")] if len(q) else q
            step = 32
            while len(q):
                now, q = q[:step], q[step:]
                step *= 4
                n = size[now]
                ends = np.cumsum(n)
                values = flat[np.repeat(at[now] - (ends - n), n) + np.arange(ends[-1])]
                k = np.minimum(np.searchsorted(parts[p], values), size[p] - 1)
                both = np.add.reduceat((parts[p][k] == values).astype(np.int64), ends - n)
                for x in now[100 * both >= percent * (n + size[p] - both)].tolist():
                    if group[x] != group[p]:
                        a.append(max(node[p], node[x]))
                        b.append(min(node[p], node[x]))
                        group[group == group[x]] = group[p]
                q = q[group[q] != group[p]]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(tidy_group(run), "a binary, b binary").distinct()


def classes_of(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, __n, __set) of all rows, and (__set, __component) of all classes."""
    seen = write_table(sketches(docs.select("doc_id", "text"), s, minima=True).select("doc_id", "__n", "__set", "__sig"), "sketches")
    nodes = write_table(seen.filter("__set IS NOT NULL").groupBy(F.col("__set").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.first("__sig").alias("_sig")), "classes")
    dealt = buckets(nodes, s)
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("n")).filter("n > 1").select("bucket", "center")
    members = write_table(dealt.join(shared, "bucket"), "buckets")

    first = (
        members.filter("node != center")
        .groupBy("node", "center")
        .agg(F.count("*").alias("n"))
        .groupBy("node")
        .agg(F.max(F.struct("n", "center")).alias("best"))
        .select(F.col("node").alias("a"), F.col("best.center").alias("b"))
    )
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    items = write_table(needed_sets(docs, wanted, s), "sets")
    links = write_table(verify(first, items, s), "links")
    groups = components(links)
    drop_tables(links)
    let_go(docs.sparkSession)

    grouped = members.join(groups, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = grouped.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("bucket", "n")
    open_buckets = write_table(grouped.join(mixed, "bucket"), "mixed")
    drop_tables(members)
    left = open_buckets.join(nodes.select("node", "_sig"), "node")
    small = verify(small_pairs(left.filter(F.col("n") <= s.small), s), items, s)
    more = write_table(small.unionByName(block_links(left.filter(F.col("n") > s.small), items, s)), "links")
    drop_tables(items, open_buckets)
    if not more.isEmpty():
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    rooted = nodes.select("node", "doc_id").join(groups, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("__component"))
    return seen.drop("__sig"), write_table(rooted.join(ids, "root").select(F.col("node").alias("__set"), "__component"), "components")


def decide(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows, of sketches(), with __component and __kept."""
    joined = rows.join(classes, "__set", "left")
    joined = joined.withColumn("__component", F.when(F.col("__set").isNull(), F.col("doc_id")).otherwise(F.col("__component")))
    return joined.withColumn("__kept", F.col("doc_id").eqNullSafe(F.col("__component")))


def results() -> list:
    return [F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("__kept").alias("kept")]


INTERNAL = ("__n", "__set", "__sig", "__component", "__kept")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with n_shingles, component_id (the least doc_id of the document's group) and kept (whether it is that document)."""
    docs, columns = aside(docs.drop("n_shingles", "component_id", "kept"), INTERNAL)
    _, classes = classes_of(docs, s)
    return decide(sketches(docs, s, minima=False), classes).select(*columns, *results())


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without near duplicates: one row of each group stays, also where rows are repeated."""
    docs, columns = aside(docs, INTERNAL)
    seen, classes = classes_of(docs, s)
    once = seen.filter("doc_id IS NOT NULL").groupBy("doc_id", "__set").count().filter("count > 1").isEmpty()
    kept = decide(sketches(docs, s, minima=False), classes).filter("__kept")
    if not once:
        kept = kept.filter("__set IS NOT NULL AND doc_id IS NOT NULL").dropDuplicates(["doc_id", "__set"]).unionByName(kept.filter("__set IS NULL OR doc_id IS NULL"))
    return kept.select(*columns)


def query(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    seen, classes = classes_of(docs.select("doc_id", "text"), s)
    return decide(seen, classes).select("doc_id", *results())


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM p
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r
), c AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r
), l AS (SELECT x, y FROM c JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l
), reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x
), m AS (SELECT reach.x AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
