"""Near duplicates against all pairs by the same weights, and rows that share ids or texts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import neardup, textnum

from .fixtures import DOCS, documents, empty, rows

SCHEMA = "doc_id long, text string"


def brute_classes(texts: list[str], idf: np.ndarray, least: float = neardup.SIMILARITY) -> list[int]:
    """The smallest index of each text's class: weighted Jaccard of every pair, then union by search."""
    weights = []
    for t in texts:
        raw, off = textnum.buffers(pa.array([t]))
        h, _, w = neardup._weighted(raw[: off[1]], off, idf)
        weights.append(dict(zip(h.tolist(), w.tolist(), strict=True)))
    near = defaultdict(set)
    for i, a in enumerate(weights):
        for j in range(i):
            b = weights[j]
            shared = sum(min(w, b[h]) for h, w in a.items() if h in b)
            if texts[i] == texts[j] or a and b and shared / (sum(a.values()) + sum(b.values()) - shared) >= least:
                near[i].add(j)
                near[j].add(i)
    out = [-1] * len(texts)
    for i in range(len(texts)):
        todo = [i] if out[i] < 0 else []
        while todo:
            k = todo.pop()
            if out[k] < 0:
                out[k] = i
                todo += near[k]
    return out


def corpus(seed: int) -> list[str]:
    """Texts of several bases at all distances, exact copies, and a passage that a third of them share."""
    rng = random.Random(seed)
    line = " ".join(f"common{k}" for k in range(25))
    texts = []
    for b in range(6):
        base = [f"b{b}w{rng.randrange(60)}" for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(8, 30)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(t) + (f" {line}" if rng.random() < 0.4 else ""))
    texts += [f"{line} " + " ".join(f"own{k}w{j}" for j in range(rng.randint(5, 12))) for k in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1])
def test_classes_equal_all_pairs(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts, neardup.inverse_frequencies(df))


@pytest.mark.parametrize(("large", "rare"), [(2, 10), (10**9, 4)])
def test_the_bound_on_large_buckets_changes_nothing(spark, monkeypatch, large, rare):
    texts = corpus(4)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "RARE", rare)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert [got[k] for k in range(len(texts))] == brute_classes(texts, neardup.inverse_frequencies(df))


def test_links_of_rare_shingles_alone(spark):
    """Every bucket is large and every node mostly its own beside what two nodes share: the pairs still become classes."""
    line = " ".join(f"c{k}" for k in range(12))
    texts = []
    for k in range(12):
        own = " ".join(f"k{k}w{j}" for j in range(60))
        texts += [f"{line} {own}", f"{line} {own} more"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}
    assert got == {k: k - k % 2 for k in range(24)}


@pytest.mark.parametrize("seed", range(1))
def test_components(spark, seed):
    """Chains, stars and rings, given at once and in two parts."""
    rng = random.Random(seed)
    names = rng.sample(range(10**6), 120)
    pairs = [(names[k], names[k + 1]) for k in range(40)] + [(names[119], names[k]) for k in range(50, 70)] + [(names[70 + k], names[70 + (k + 1) % 9]) for k in range(9)]
    pairs += [(names[100 + k], names[100 + k // 2]) for k in range(1, 15)]
    rng.shuffle(pairs)
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")
    assert {r["node"]: r["root"] for r in neardup.components(links, "test").collect()} == root
    first = neardup.components(links.limit(len(pairs) // 2), "test")
    half = spark.createDataFrame(links.collect()[len(pairs) // 2 :], links.schema)
    assert {r["node"]: r["root"] for r in neardup.components(half, "test", first).collect()} == root


def test_rows_that_share_ids_and_texts(spark):
    words = lambda k: " ".join(f"t{k}w{j}" for j in range(30))
    data = [(1, words(0)), (1, words(0)), (1, words(1)), (2, words(1)), (3, words(0)), (None, words(2)), (None, words(2)), (None, words(3)), (4, words(3)), (5, None), (5, None), (6, ""), (7, " \t"), (8, " \t")]
    df = spark.createDataFrame(data, SCHEMA)
    found = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in neardup.classes(df).collect())
    assert found[1, 1, True] == 3 and found[2, 1, False] == 1 and found[3, 1, False] == 1 and found[4, 4, True] == 1
    assert all(found[k, k, True] for k in (6, 7, 8)) and found[5, 5, True] == 2
    kept = sorted((repr(tuple(r)) for r in neardup.deduplicated(df).collect()))
    want = [(1, words(0)), (1, words(1)), (None, words(2)), (4, words(3)), (5, None), (6, ""), (7, " \t"), (8, " \t")]
    assert kept == sorted(repr(t) for t in want)


def test_columns_that_clash(spark):
    df = documents(spark)
    more = df.withColumns({"id": F.lit(1), "digest": F.lit("x"), "row": F.lit(2), "node": F.lit(3.5), "_gone": F.lit(None).cast("int")})
    got = neardup.deduplicated(more)
    assert got.columns == more.columns
    assert {r["doc_id"] for r in got.collect()} == {i for i, *_ in rows()} - {1, 2, 8, 13}  # 13 copies 12
    none = spark.createDataFrame([], DOCS)
    assert neardup.deduplicated(none).count() == 0 and neardup.classes(empty(spark)).count() == 0


def test_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(10**5)}" for _ in range(200_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one of six words here")], SCHEMA)
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()} == {1: 1, 2: 1, 3: 3}
