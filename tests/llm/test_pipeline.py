"""The pipeline's stages: what stays, and that each acts on what its predecessor kept."""

import re

import corpus_pipeline as C
import numpy as np
from gridsmith.llm.common import write_table

from .conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(max(1, len(w) - 9))}
    before = texts
    for name, stage in C.STAGES[:-1]:
        docs = write_table(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(now) <= set(before) and len(now) == docs.count()
        if name == "language_id":
            assert set(before) - set(now) == {k for k, t in before.items() if not any(c.isalpha() for c in t or "")}
        if name == "line_dedup":
            key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
            holders: dict[str, set] = {}
            for k, t in before.items():
                for x in t.split("\n"):
                    holders.setdefault(key(x), set()).add(k)
            for k, t in before.items():
                seen, kept = set(), []
                for x in t.split("\n"):
                    many = key(x) and len(holders[key(x)]) >= 10
                    if not many or (min(holders[key(x)]) == k and key(x) not in seen):
                        kept.append(x)
                    seen.add(key(x))
                if k in now:
                    assert now[k] == "\n".join(kept)
                else:
                    assert not "".join(kept).strip()
        if name == "decontamination":
            hit = {k for k, t in before.items() if any(tuple(words(t)[i : i + 10]) in windows for i in range(len(words(t)) - 9))}
            assert set(now) == set(before) - hit
        before = now
    last = C.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == len(before) and last.filter("NOT lossless").count() == 0
    assert C.run(spark, SMALL).count() == len(before)


def test_odd_and_empty_documents(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, 3), (2, "a b", None, None, 3), (3, "123", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for table in (odd, odd.filter("false")):
        docs = table
        for name, stage in C.STAGES:
            docs = write_table(stage(spark, docs, SMALL), name)
        assert docs.count() <= 1


def test_near_dedup_against_brute_force(spark, docs):
    rng = np.random.default_rng(13)
    vocabulary = [f"v{i}" for i in range(5_000)]
    texts = []
    for n in (94, 104, 114, 124) * 4:
        base = list(rng.choice(vocabulary, n))
        texts.append(" ".join(base))
        # Words far from each other and from the ends: each takes five shingles.
        for changes in (len(texts) % 4, 2, 3):
            other = list(base)
            for k in range(changes):
                other[10 + 25 * k + int(rng.integers(0, 15))] = str(rng.choice(vocabulary))
            texts.append(" ".join(other))
    texts += ["few words", "few words", "", None]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group, between = list(range(len(sets))), 0
    for i in range(len(sets)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= 80 * either:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
                between += 100 * both < 85 * either
    assert between > 10
    got = C.near_dedup(spark, docs(list(enumerate(texts))), SMALL)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(set(group))
