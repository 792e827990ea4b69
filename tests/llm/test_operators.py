"""Each operator against brute force, and on odd tables."""

import collections
import functools
import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridsmith.llm import chat, components, decontam, fingerprint, langid, line_dedup, lm, minhash, pieces, quality, queries, suffix_dedup
from gridsmith.llm import textkit as K

from .conftest import SMALL


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.SQL[name])
    order = [got.columns.index(c[0]) for c in want.description]
    same = lambda v: "~" if v is None else round(v, 3) if isinstance(v, float) else v
    assert sorted(str([same(r[i]) for i in order]) for r in rows(got)) == sorted(str([same(v) for v in r]) for r in want.fetchall())


def test_columns_of_clashing_names_are_kept(odd):
    """Each operator replaces the columns it adds and keeps all others as they are."""
    added = {
        "op1": (quality.score(odd, quality.Model(np.zeros(1 << 20, np.float32), 0.0)), {"score", "predicted"}),
        "op2": (suffix_dedup.drop_repeats(odd), {"kept", "n_bytes", "n_removed", "spans"}),
        "op4": (line_dedup.drop_lines(odd, line_dedup.Settings(min_docs=2, broadcast_bytes=0)), {"kept", "n_lines", "n_dropped"}),
        "op6": (minhash.near_duplicates(odd), {"n_shingles", "component_id", "kept"}),
        "op6 kept": (minhash.one_of_each(odd), set()),
        "op7": (langid.identify(odd, langid.Model(("en",), (b"a b c ",))), {"lang_pred", "score"}),
        "op8": (lm.score(odd), {"n_words", "logp", "perplexity"}),
        "op9": (pieces.encode(odd), {"piece_ids"}),
        "op10": (fingerprint.fingerprint(odd.fillna("", "text"), "text", "fp"), {"fp"}),
    }
    for name, (got, new) in added.items():
        assert set(got.columns) == set(odd.columns) | new, name
        mine = [c for c in odd.columns if c not in new | {"doc_id", "text", "lang"}]
        assert got.select(*mine).distinct().collect() == [tuple(["clash"] * len(mine))], name


def test_word_hashes():
    texts = ["The the", None, "", " a  b\n", "x" * 300 + " y", "é É"]
    data, at = K.utf8(pa.array(texts))
    h, start, end, first = K.words(data, at, ~K.SPACE)
    assert np.diff(first).tolist() == [2, 0, 0, 2, 2, 2] and h[0] == h[1] and len(set(h.tolist())) == 7
    g, g_at = K.ngrams(h, first, 2, whole=True)
    assert np.diff(g_at).tolist() == [1, 0, 0, 1, 1, 1]
    single = K.words(*K.utf8(pa.array(["b", "y"])), ~K.SPACE)[0]
    assert single[0] == h[3] and single[1] == h[5]


def test_quality_learns_from_rows_that_are_not_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.query(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.predicted == got.quality).mean() > 0.95
    # The labels of held-out rows play no part.
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs.limit(50)
    assert rows(quality.query(few, labels).orderBy("doc_id")) == rows(quality.query(few, turned).orderBy("doc_id"))


def test_ftrl_against_a_plain_implementation():
    """Follow-the-regularised-leader, coordinate by coordinate, as it is published."""
    rng = np.random.default_rng(12)
    s = quality.Settings(bits=6, epochs=2, l1=0.05)
    rows = [(np.unique(rng.integers(0, 64, 9)), int(rng.random() < 0.3)) for _ in range(200)]
    rows = [(at, rng.random(len(at)), y) for at, y in rows]
    ones = sum(y for *_, y in rows)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= s.l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for at, x, y in rows:
            given = {**dict(zip(at.tolist(), x.tolist())), "bias": 1.0}
            w = {i: weight(i) for i in given}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in given.items())))
            for i, v in given.items():
                g = len(rows) / (2 * (ones if y else len(rows) - ones)) * (p - y) * v
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w[i]
                n[i] += g * g
    got = quality.fit(rows, s)
    assert np.allclose(got.weights, [weight(i) for i in range(64)], atol=1e-6) and abs(got.bias - weight("bias")) < 1e-9


def test_quality_learns_from_bounded_texts(docs):
    labels = docs([(i, "x") for i in range(12)]).sparkSession.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    table = docs([(i, ("good plain words here" if i % 2 else "bad bad bad bad") * (1 if i else 40_000)) for i in range(12)])
    short = table.filter(F.length("text") < 1_000)
    assert quality.train(table, labels).bias == quality.train(short, labels).bias


def test_quality_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None), (None, 1), (6, 0), (1, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model)
    assert got.columns[-2:] == ["score", "predicted"] and got.count() == odd.count() and got.filter("score IS NULL").count() == 0
    assert quality.query(none, labels.filter("false")).count() == 0
    assert {r["score"] for r in quality.query(odd, labels.filter("false")).collect()} == {0.5}


def brute_repeats(texts, length):
    count = collections.Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most_segments", [20_000, 1])
def test_repeats_against_brute_force(spark, docs, most_segments):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcd"), 3)) for _ in range(n))
    passage, base = word(80), word(300)
    texts = [base, base, base[:400] + "X" + base[401:], word(60) + passage + word(40), passage, word(10) + passage[:250], "ab" * 400, "z" * 450, passage[:199], "é" * 230, "", None]
    got = suffix_dedup.query(docs(list(enumerate(texts))), suffix_dedup.Settings(most_segments=most_segments)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats([(t or "").encode() for t in texts], 200)


def test_strings_of_a_few_words_choose_no_segments(docs):
    """Every string of 16 bytes over two letters occurs several times here, one passage of 300 bytes does so too."""
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("ab"), n))
    passage = letters(300)
    texts = [letters(4_000) + ({3: "c", 50: "d"}[i] + passage if i in (3, 50) else "") for i in range(100)]
    table = docs(list(enumerate(texts)))
    assert 0 < suffix_dedup.occurrences(table, suffix_dedup.Settings()).count() < 100
    # A filter that is far too small lets more through, and changes nothing.
    for filter_bytes in (1 << 14, 64 << 20):
        got = suffix_dedup.query(table, suffix_dedup.Settings(filter_bytes=filter_bytes)).orderBy("doc_id").collect()
        assert [r["n_removed"] for r in got] == [300 * (i in (3, 50)) for i in range(100)]


def test_shards_are_bounded_whatever_repeats(docs):
    """A passage of 150 bytes in 600 different texts: an anchor of hundreds of segments, 30 KB a shard."""
    rng = np.random.default_rng(12)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage, s = letters(150), suffix_dedup.Settings(shard_bytes=30_000)
    texts = [letters(250) + passage + letters(250) for _ in range(600)]
    table = docs(list(enumerate(texts)))
    places = suffix_dedup.occurrences(table, s)
    opened = places.groupBy("anchor").agg(F.countDistinct("segment").alias("segments")).filter("segments > 1")
    assert opened.agg(F.max("segments")).first()[0] > 300
    by_shard = suffix_dedup.collections(table, opened, s).groupBy("shard").agg(F.sum(F.length("bytes")).alias("n"))
    assert by_shard.agg(F.max("n")).first()[0] < 3 * s.shard_bytes
    texts += [texts[7], texts[8][20:500]]
    got = suffix_dedup.query(docs(list(enumerate(texts))), s).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats([t.encode() for t in texts], 200)


def test_repeats_in_long_texts_are_read_in_pieces(docs, monkeypatch):
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefgh "), 9_000))
    texts = [long, "q" + long[3_000:4_000] + "q", long[4_090:4_400]]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1_000)
    data, at = K.utf8(pa.array(texts))
    found = [(h, lo, base + f) for lo, _, x, x_at, base in suffix_dedup.pieces(data, at, 200) for h, f, n in zip(*suffix_dedup.anchors(x, x_at, 200)) for f in range(f, f + n)]
    windows = collections.Counter(lo for _, lo, _ in found if lo == 0)
    assert windows[0] == 9_000 - 199


def test_columns_are_sorted_suffixes():
    rng = np.random.default_rng(1)
    symbols = rng.integers(1, 4, 3_000)
    step = suffix_dedup.SYMBOL
    begin = np.arange(0, 10 * step, 7)
    size = rng.integers(0, 9, len(begin))
    owner, length, shared = suffix_dedup.insert_columns(symbols, begin, size, 99)
    read = lambda d, n: [int(symbols[begin[d] + step * (size[d] - k)]) for k in range(n, 0, -1)]
    order = [(read(d, n) + [0, -1000 + d]) for d, n in zip(owner.tolist(), length.tolist())]
    assert [x[: x.index(0)] for x in order] == sorted(x[: x.index(0)] for x in order)
    for a, b, n in zip(order, order[1:], shared[1:].tolist()):
        a, b = a[: a.index(0)], b[: b.index(0)]
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == want


def test_repeats_on_odd_tables(odd, none):
    got = suffix_dedup.drop_repeats(odd)
    assert got.count() == odd.count() and "anchor" in got.columns
    long = got.filter("doc_id in (6, 7)").select("n_bytes", "n_removed").distinct().collect()
    assert len(long) == 1 and long[0]["n_bytes"] == long[0]["n_removed"]
    assert suffix_dedup.query(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.repeats(none, suffix_dedup.Settings(length=77))


def test_preferences(spark):
    turn = "struct<role:string,text:string>"
    data = [
        (1, [("user", "hi"), ("assistant", "a<|b"), ("user", "more")], [("user", "hi"), ("assistant", "c\\")]),
        (2, [("user", "x")], [("user", "x")]),
        (3, None, [("assistant", "y")]),
        (4, [(None, None), ("assistant", "1")], [(None, None), ("assistant", "2")]),
        (5, [("user", "x"), ("assistant", "y")], [("user", "x")]),
    ]
    got = {r["pair"]: r for r in chat.format_pairs(spark.createDataFrame(data, f"pair int, chosen array<{turn}>, rejected array<{turn}>").withColumn("prompt", F.lit("clash"))).collect()}
    r = got[1]
    assert r["prompt"] == "<|user|>\nhi<|end|>\n" and r["n_prompt_turns"] == 1 and r["valid"]
    assert r["chosen_completion"] == "<|assistant|>\na<\\|b<|end|>\n<|user|>\nmore<|end|>\n"
    assert [r["chosen_completion"][s["start"] : s["end"]] for s in r["chosen_mask"]] == ["a<\\|b<|end|>\n"]
    assert [r["rejected_completion"][s["start"] : s["end"]] for s in r["rejected_mask"]] == ["c\\\\<|end|>\n"]
    assert not got[2]["valid"] and got[2]["chosen_completion"] == "" and not got[3]["valid"] and got[4]["valid"] and got[4]["prompt"] == "<|unknown|>\n<|end|>\n" and not got[5]["valid"]
    # No role can pass for another turn's marker, and columns of any name are kept.
    forged = [(1, [("a|>\nfoo", "x")], [("a", "foo|>\nx")])]
    r = chat.format_pairs(spark.createDataFrame(forged, f"_a int, chosen array<{turn}>, rejected array<{turn}>").withColumns({"a": F.lit(7), "_p": F.lit(8)})).first()
    assert r["n_prompt_turns"] == 0 and r["chosen_completion"] != r["rejected_completion"] and (r["_a"], r["a"], r["_p"]) == (1, 7, 8)
    assert r["chosen_completion"] == "<|a|\\>\\nfoo|>\nx<|end|>\n"
    lost = spark.createDataFrame([(None, 1, "user", "q"), (None, 2, "assistant", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [r["n_turns"] for r in chat.query(lost).collect()] == [1, 1, 1]
    talks = spark.createDataFrame([(1, 1, "user", "q"), (1, 1, "user", "q"), (None, None, None, None), (2, 2, "assistant", "b"), (2, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.query(talks).collect()}
    assert out[1]["n_turns"] == 2 and not out[1]["valid"] and out[2]["valid"] and not out[None]["valid"]
    assert chat.query(talks.filter("false")).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_by_either_way(docs, broadcast_bytes, keep_first):
    texts = [f"Shared {i % 2}\nown {i}\n\t SHARED 0 \n\nx" for i in range(12)] + [None, "", "shared 1\r"]
    s = line_dedup.Settings(broadcast_bytes=broadcast_bytes, keep_first=keep_first, min_docs=6)
    got = line_dedup.drop_lines(docs(list(enumerate(texts))), s).orderBy("doc_id").collect()
    key = lambda x: x.strip(" \t\n\v\f\r").lower()
    split = [(t or "").split("\n") for t in texts]
    n = collections.Counter(k for ls in split for k in {key(x) for x in ls if key(x)})
    seen = set()
    for r, ls in zip(got, split):
        kept = []
        for x in ls:
            drop = n[key(x)] >= 6
            if drop and keep_first and key(x) not in seen:
                seen.add(key(x))
                drop = False
            if not drop:
                kept.append(x)
        assert (r["kept"], r["n_lines"], r["n_dropped"]) == ("\n".join(kept), len(ls), len(ls) - len(kept))


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_long_lines_whose_polynomial_hashes_collide(docs, broadcast_bytes):
    one = thue_morse(2_048)
    other = one.translate(str.maketrans("ab", "ba"))
    folded = np.frombuffer((one + other).encode(), np.uint8)
    at = np.array([0, 2_048, 4_096])
    h = K.spans(K.prefix_sums(folded), at[:-1], at[1:])
    assert h[0] == h[1] and len(set(K.safe(h, folded, at[:-1], at[1:]).tolist())) == 2
    table = docs([(i, f"{one}\n{other}") for i in range(12)] + [(20, "clean line"), (21, one)])
    got = line_dedup.drop_lines(table, line_dedup.Settings(broadcast_bytes=broadcast_bytes)).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["kept"]) for r in got] == [(2, 2, "")] * 12 + [(1, 0, "clean line"), (1, 1, "")]


def test_lines_joined_keep_clashing_columns(odd):
    s = line_dedup.Settings(min_docs=3, broadcast_bytes=0)
    table = odd.withColumns({"text_key": F.lit("mine"), "found": F.lit("mine"), "FLAG": F.lit("mine")})
    got, want = line_dedup.drop_lines(table, s), line_dedup.drop_lines(table, line_dedup.Settings(min_docs=3))
    assert set(got.columns) == set(want.columns) and got.filter("text_key = 'mine' AND found = 'mine' AND `FLAG` = 'mine'").count() == odd.count()
    show = lambda df: sorted(str(r) for r in rows(df.select("doc_id", "kept", "n_lines", "n_dropped", "_key")))
    assert show(got) == show(want)


def test_lines_with_a_full_filter_and_odd_tables(odd, none, docs):
    many = docs([(i, "\n".join(f"line {j}" for j in range(i, i + 40))) for i in range(60)])
    tight = line_dedup.Settings(filter_bytes=line_dedup.BLOCK, min_docs=10)
    assert rows(line_dedup.query(many, tight).orderBy("doc_id")) == rows(line_dedup.query(many).orderBy("doc_id"))
    got = line_dedup.drop_lines(odd, line_dedup.Settings(min_docs=3))
    assert got.count() == odd.count() and got.filter("doc_id = 8").first()["n_dropped"] == 0
    assert got.filter("text = 'a b c d e f g'").select("kept").distinct().collect()[0][0] == ""
    assert line_dedup.query(none).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_windows_by_any_blocks(spark, docs, block_bytes):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:12])), (2, "Short Item!"), (1, " ".join(words[20:31])), (3, ""), (4, None), (None, "lost"), (10, " ".join(words[:10]))], "item_id long, text string")
    texts = [" ".join(words), "a short,item b", "short x item", " ".join(words[1:11]), None, "", " ".join(words[21:31]) + " w0"]
    got = decontam.find_windows(docs(list(enumerate(texts))), items, decontam.Settings(block_bytes=block_bytes)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["item_ids"]) for r in got] == [(40, 23, ["1", "10"]), (4, 2, ["2"]), (3, 0, []), (10, 10, ["1"]), (0, 0, []), (0, 0, []), (11, 10, ["1"])]
    assert [(s["start"], s["end"]) for s in got[0]["hit_spans"]] == [(0, 12), (20, 31)]


@pytest.mark.parametrize("block_bytes", [16 << 20, 20])
def test_windows_of_items_without_an_id(spark, docs, block_bytes):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(None, " ".join(words[:12])), (None, "Lost item"), (1, " ".join(words[8:20])), (None, None), (2, "lost item")], "item_id long, text string")
    texts = [" ".join(words), " ".join(words[:11]), "a lost, item", "lost", None]
    for some, ids in ((items, [["1"], [], ["2"], [], []]), (items.filter("item_id IS NULL"), [[]] * 5)):
        got = decontam.find_windows(docs(list(enumerate(texts))), some, decontam.Settings(block_bytes=block_bytes)).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"]) for r in got] == [(40, 20 if ids[0] else 12), (11, 11), (3, 2), (1, 0), (0, 0)]
        assert [r["item_ids"] for r in got] == ids
    out = {r["doc_id"]: r for r in decontam.query(docs(list(enumerate(texts))), items.filter("item_id IS NULL")).collect()}
    assert [out[i]["contaminated"] for i in range(5)] == [True, True, True, False, False] and out[1]["n_items"] == 0


def test_windows_on_odd_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    got = decontam.find_windows(odd, items)
    assert got.filter("n_hit = 7").count() == 3 and got.count() == odd.count()
    assert decontam.query(odd, items.filter("false")).filter("contaminated").count() == 0 and decontam.query(none, items).count() == 0


@pytest.mark.parametrize("small,block", [(16, 4096), (2, 3)])
def test_near_duplicates_against_brute_force(docs, small, block):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3_000)]
    texts = []
    for _ in range(6):
        base = list(rng.choice(vocabulary, 120))
        texts.append(" ".join(base))
        for _ in range(12):
            other = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 4)):
                other[at] = str(rng.choice(vocabulary))
            texts.append(" ".join(other))
    texts += [texts[0], "few words", "few words", "", None]
    got = minhash.query(docs(list(enumerate(texts))), minhash.Settings(small=small, block=block)).orderBy("doc_id").collect()
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert [(r["n_shingles"], r["component_id"]) for r in got] == [(len(s), g) for s, g in zip(sets, group)]


def test_near_duplicates_on_odd_tables(odd, none):
    got = minhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.filter("text = 'a b c d e f g'").select("component_id").distinct().collect()[0][0] == 1
    assert got.filter("text = 'a b c d e f g' AND doc_id IS NULL").first()["kept"] is False
    kept = minhash.one_of_each(odd)
    assert kept.filter("text = 'a b c d e f g'").count() == 1 and kept.filter("doc_id in (6, 7)").count() == 1 and kept.filter("doc_id in (2, 3, 4)").count() == 3
    assert minhash.query(none).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 60)] + [("9000", f"{i}") for i in range(9001, 9100)] + [(f"{a}", f"{b}") for a, b in rng.integers(2000, 2100, (60, 2))]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a string, b string"))))
    parent: dict[str, str] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_language_id(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(table).join(table.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_phrases_are_longest_matches():
    samples = (b"the cat sat on the mat ", b"aaabbb aab ")
    model = langid.Model(("x", "y"), samples)
    texts = [b"the mat sat the cat zzz", b"aabbaa b", b"q" * 300, b"the cat " * 90, b"", b"aabbaabba" * 400, b"the cat sat on the mat aaabbb aab " * 70]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.phrases(model, np.frombuffer(b"".join(texts), np.uint8), at)
    for row, t in zip(got, texts):
        for n, sample in zip(row, samples):
            want, phrase = 0, b""
            for c in t:
                if phrase + bytes([c]) in sample:
                    phrase += bytes([c])
                else:
                    want += 1
                    phrase = bytes([c]) if bytes([c]) in sample else b""
            assert n == want + (len(t) > 0)


def test_language_samples_are_whole_documents(docs):
    texts = ["a b " * 30_000, "first text", "second text", None, "", "third " * 2_000, "fourth " * 3_000]
    table = docs([(i * 5 + 3, t) for i, t in enumerate(texts)]).filter(~quality.held_out(F.col("doc_id")))
    of = {r["doc_id"]: r["text"] for r in table.collect()}
    sample = langid.train(table).samples[0].decode()
    whole = {k: "".join(langid.symbols(*K.utf8(pa.array([t])))[0].tobytes().decode()) + " " for k, t in of.items() if t is not None}
    rest = sample
    for k in sorted(whole, key=lambda k: -len(whole[k])):
        if whole[k] and len(whole[k]) > 1 and whole[k] in rest:
            rest = rest.replace(whole[k], "", 1)
    assert not rest.strip() and len(sample) <= 33_000
    # A language that has only a long document learns from all of it.
    assert len(langid.train(table.filter(F.length("text") > 100_000)).samples[0]) > 32_768 or not any(len(t or "") > 100_000 for t in of.values())


def test_language_id_on_odd_tables(odd, none):
    model = langid.train(odd)
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(odd, model).collect()}
    assert got[(2, None)]["lang_pred"] == "und" and got[(3, "")]["score"] == 0.0 and got[(5, "x")]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in langid.query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.query(none).count() == 0


@pytest.mark.parametrize("shard_pairs", [1_800_000, 3])
def test_scores_against_brute_force(docs, shard_pairs):
    texts = ["the cat sat", "The cat ran", "the dog", "the the the the", "", None, "the cat sat"]
    got = lm.score(docs(list(enumerate(texts))).withColumn("logp", F.lit(1)), lm.Settings(shard_pairs=shard_pairs)).orderBy("doc_id").collect()
    words = [(t or "").lower().split() for t in texts]
    c = collections.Counter(w for ws in words for w in ws)
    pairs = collections.defaultdict(list)
    for i, ws in enumerate(words):
        for p in zip(ws, ws[1:]):
            pairs[p].append(i)
    total = sum(c.values())
    for r, ws in zip(got, words):
        want = 0.0
        for i, w in enumerate(ws):
            p = pairs[(ws[i - 1], w)] if i else []
            want += np.log(c[w] / total) if not i else np.log(len(p) / c[ws[i - 1]]) if len(set(p)) > 1 else np.log(0.4 * c[w] / total)
        assert r["n_words"] == len(ws) and abs(r["logp"] - want) < 1e-9
        assert r["perplexity"] is None if not ws else abs(r["perplexity"] - np.exp(-want / len(ws))) < 1e-6


def test_frequent_words_are_counted_over_all_rows(docs):
    # A group of copies alone holds some frequent words, and there are more of these than a thousand.
    texts = ["held by copies only"] * 30 + [" ".join(f"w{i}" for i in range(1_500))] * 6 + ["w1 once", "", None]
    c = collections.Counter(w for t in texts for w in (t or "").split())
    total, often, counts = lm.totals(docs(list(enumerate(texts))).select("text"), lm.Settings(shard_pairs=5))
    of = dict(zip(lm.words48(*K.utf8(pa.array([" ".join(c)])))[0].tolist(), c.values()))
    assert total == sum(c.values()) and dict(zip(often.tolist(), counts.tolist())) == {h: n for h, n in of.items() if n > 5}
    assert len(often) == 1_504 and (np.diff(often.astype(np.int64)) > 0).all()


def test_scores_on_odd_tables(odd, none):
    got = lm.score(odd)
    assert got.count() == odd.count() and got.filter("text = 'a b c d e f g'").select("logp").distinct().count() == 1
    assert lm.query(none).count() == 0


def test_pieces_are_lossless_and_reproducible(odd, none, docs):
    both = pieces.decode(pieces.encode(odd))
    assert both.filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0
    assert both.filter("text IS NULL AND piece_ids IS NOT NULL").count() == 0
    assert rows(pieces.query(odd).orderBy("doc_id", "n_pieces")) == rows(pieces.query(odd.repartition(5)).orderBy("doc_id", "n_pieces"))
    texts = ["  two  spaces \n\n", "tab\tand\r\nline", "▁sign", "é漢😀", "y" * 2_000, "\x00"]
    assert pieces.query(docs(list(enumerate(texts)))).filter("NOT lossless").count() == 0
    assert pieces.query(none).count() == 0
    other = pieces.encode(docs([(1, "reproducible segmentation " * 20)]), s=pieces.Settings(seed=2)).first()["piece_ids"]
    assert other != pieces.encode(docs([(1, "reproducible segmentation " * 20)])).first()["piece_ids"]


def test_long_units_are_filtered_exactly(monkeypatch):
    v = pieces.load()
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abcdenorst"), 900)) + "漢é" * 60 + "\U0001f600z" * 9
    x = np.frombuffer(text.encode(), np.uint8)
    keys = np.arange(1, 4, dtype=np.uint64)
    short = [pieces.sample_units(v, x, np.array([0, len(x)]), np.array([k]))[0].tolist() for k in keys]
    for part in (1 << 16, 100, 7):
        monkeypatch.setattr(pieces, "PART", part)
        assert [pieces.sample_long(v, x, k).tolist() for k in keys] == short
    # Units around long ones, a text of many runs, and rows that end in the middle.
    texts = ["one two " + "y" * 3_000 + " three", "", "q" * 1_025, "plain words " * 20, "é" * 700 + "\n\n" + " " * 1_500 + "x"]
    data, at = K.utf8(pa.array(texts))
    whole = pieces.sample(v, data, at, pieces.row_key(list(range(5)), 1))
    monkeypatch.setattr(pieces, "CHUNK", 64)
    again = pieces.sample(v, data, at, pieces.row_key(list(range(5)), 1))
    assert whole[0].tolist() == again[0].tolist() and whole[1].tolist() == again[1].tolist()
    for t, a, b in zip(texts, whole[1][:-1], whole[1][1:]):
        assert b"".join(v.texts[i] for i in whole[0][a:b]).decode() == t
    # Pieces cross what was once a cut.
    assert max(len(v.texts[i]) for i in whole[0][whole[1][0] : whole[1][1]]) > 1


def test_row_keys_are_told_apart_by_all_their_text():
    assert len(set(pieces.row_key(["document-1", "document-2", None, 1, 2, "1"], 1).tolist())) == 6


def test_segmentations_have_their_exact_chance():
    v = pieces.load()
    word = "token"
    of = {v.texts[i]: w for i, w in zip(v.ids.tolist(), v.weights.tolist())}

    def ways(t):
        if not t:
            yield (), 0.0
        for i in range(1, len(t) + 1):
            if t[:i].encode() in of:
                for rest, w in ways(t[i:]):
                    yield (t[:i].encode(), *rest), w + of[t[:i].encode()]

    chance = {p: np.exp(w) for p, w in ways(word)}
    total = sum(chance.values())
    n = 40_000
    data = np.frombuffer(word.encode() * n, np.uint8)
    ids, first = pieces.sample(v, data, np.arange(n + 1) * len(word), pieces.row_key(list(range(n)), 1))
    seen = collections.Counter(tuple(v.texts[i] for i in ids[a:b]) for a, b in zip(first[:-1], first[1:]))
    assert set(seen) <= set(chance)
    for p, c in chance.items():
        assert abs(seen[p] / n - c / total) < 0.015


def test_fingerprints(spark, docs):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, n)) for n in (400, 30, 7, 3, 1)] + ["", None]
    texts.append(texts[0])
    got = {r["doc_id"]: r for r in fingerprint.query(docs(list(enumerate(texts)))).collect()}
    order = sorted(got, reverse=True)
    for i, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(t) // 2
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
    assert got[0]["fingerprint"] == got[7]["fingerprint"] and len(got[0]["fingerprint"]) == 256 and got[5]["fingerprint"] == got[6]["fingerprint"] == ""
    assert got[6]["near_next"] == 1.0 and 0 <= got[0]["near_edited"] <= 1


def brute_fingerprint(text):
    """One-permutation MinHash, bin by bin, over the same hashes."""
    words = [w for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    if not words:
        return None
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    chained = lambda part: functools.reduce(lambda seed, x: xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest(), part, 42)
    least = [None] * fingerprint.BINS
    for x in {chained(h[i : i + 5]) for i in range(max(1, len(h) - 4))}:
        b, v = x % 128, x >> 7 & (1 << 56) - 1
        least[b] = v if least[b] is None else min(least[b], v)
    order = [[row[b] for row in fingerprint.probes()] for b in range(128)]
    assert all(sorted(o) == list(range(128)) for o in order)
    return [(least[b] if least[b] is not None else next(least[k] for k in order[b] if least[k] is not None)) & 255 for b in range(128)]


def test_fingerprints_against_brute_force(spark, docs):
    rng = np.random.default_rng(6)
    words = [f"W{i}f" for i in range(300)] + ["f", "é", "漢字", "x" * 300]
    texts = [" ".join(rng.choice(words, n)) for n in (900, 300, 60, 12, 6, 5, 4, 1)] + [" \t\n\v\f\r", "", None, "\n a\tb "]
    got = {r["doc_id"]: r for r in fingerprint.query(docs(list(enumerate(texts)))).collect()}
    order = sorted(got, reverse=True)
    for i, k in enumerate(order):
        t, nxt = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, of_edited, of_next = map(brute_fingerprint, (t, edited, nxt))
        assert got[k]["fingerprint"] == ("" if own is None else bytes(own).hex())
        assert got[k]["edited_fingerprint"] == ("" if of_edited is None else bytes(of_edited).hex())
        for name, other in (("near_edited", of_edited), ("near_next", of_next)):
            if own is None or other is None:
                want = float(own is other)
            else:
                want = max(0.0, (sum(map(int.__eq__, own, other)) / 128 - 1 / 256) / (1 - 1 / 256))
            assert abs(got[k][name] - want) < 1e-8


def test_fingerprints_of_text_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_GROUP", 3)
    ids = [f"document-{i:05d}" for i in range(40)]
    df = spark.createDataFrame([(k, f"text {k} " * 3) for k in ids] + [("document-00007", "text again"), (None, "without id")], "doc_id string, text string")
    got = fingerprint.with_next(df.withColumn("_g", F.lit(1)), ["text"]).collect()
    assert len(got) == 42 and "_g" in got[0]
    nxt = {(r["doc_id"], r["text"]): r["next_text"] for r in got}
    for a, b in zip(ids[1:], ids):
        assert b == "document-00007" or a == "document-00007" or nxt[(a, f"text {a} " * 3)] == f"text {b} " * 3
    assert nxt[("document-00000", "text document-00000 " * 3)] == "without id" and nxt[(None, "without id")] == "text document-00039 " * 3


def test_likeness_estimates_jaccard(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 9_999, 600)]
    errors = []
    data = []
    for i in range(40):
        other = base[: 600 - 12 * i] + [f"w{x}" for x in rng.integers(0, 9_999, 12 * i)]
        data.append((" ".join(base), " ".join(other)))
    df = fingerprint.fingerprint(fingerprint.fingerprint(spark.createDataFrame(data, "a string, b string"), "a", "fa"), "b", "fb")
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for r in df.select("a", "b", fingerprint.likeness(F.col("fa"), F.col("fb")).alias("x")).collect():
        a, b = sh(r["a"]), sh(r["b"])
        errors.append(r["x"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.16


def test_fingerprints_on_odd_tables(odd, none, docs):
    got = fingerprint.query(odd)
    assert got.count() == odd.count() and got.filter("near_edited IS NULL OR near_next IS NULL").count() == 0
    assert fingerprint.query(none).count() == 0
    assert fingerprint.query(odd.filter("doc_id IS NULL")).filter("near_next IS NULL").count() == 0
    # Neighbours are found across groups too.
    fingerprint_rows, fingerprint.ROWS_PER_GROUP = fingerprint.ROWS_PER_GROUP, 3
    try:
        got = fingerprint.query(docs([(i * 3, f"text {i} " * (i % 5 + 1)) for i in range(40)])).orderBy("doc_id").collect()
    finally:
        fingerprint.ROWS_PER_GROUP = fingerprint_rows
    texts = [f"text {i} " * (i % 5 + 1) for i in range(40)]
    for i, r in enumerate(got):
        t, nxt = texts[i], texts[i - 1]
        assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


def test_native_operators_run_no_python(spark):
    for df in (fingerprint.query(spark.read.parquet(f"{SMALL}/documents.parquet")), chat.query(spark.read.parquet(f"{SMALL}/conversations.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
