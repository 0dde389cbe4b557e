"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences.  A sentence's score is a logistic sum over its words and word stems; the document's
is the noisy-or of them, 1 - prod(1 - p).  Only document labels are needed to train: the likelihood of the noisy-or
itself is climbed, and the sentence scores it leaves say where a document offends.

Training takes a bounded sample, FIT_DOCS labelled documents in the order of a hash of their id.  Features are
counted per label in tables of fixed size; those that mark toxic documents beyond chance (at most FEATURES) are
fitted.  Scoring covers every whole text.

Defined results: a null or empty text has no sentence and scores the chance of a bag without any sentence, just over
0; null labels are not used; where labels disagree for one doc_id all its rows count; without labels of both kinds
every score is the share of toxic labels (0 if there are none); repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum

FIT_DOCS = 20_000
FEATURE_BITS = 20
FEATURES = 6_000
STEMS = (5, 6, 7, 8)
STEPS, RATE, PENALTY = 400, 0.1, 0.02
IS_GAP = np.ones(256, bool)
IS_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
IS_END = np.zeros(256, bool)
IS_END[[10, 13, 33, 46, 63]] = True


def features(data: np.ndarray, off: np.ndarray):
    """Words of a block of texts: starts, text of each, sentence of each (numbered through the block), and features.

    Features: (word, kind) numbers below 2**FEATURE_BITS; the whole word and its stems of 5 to 8 bytes; -1 where a
    word is shorter than the stem.
    """
    s, e, first = textnum.word_bounds(data, off, IS_GAP)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    ends = np.cumsum(IS_END[data])
    part = ends[s] if len(s) else np.zeros(0, np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    sums = textnum.word_sums(data, s, textnum.FOLDED_VALUES)
    out = np.full((len(s), 1 + len(STEMS)), -1, np.int64)
    shift = np.uint64(64 - FEATURE_BITS)
    out[:, 0] = (textnum.mix(sums[e] - sums[s]) >> shift).astype(np.int64)
    for k, n in enumerate(STEMS):
        long = np.flatnonzero(e - s > n)
        h = textnum.mix(sums[s[long] + n] - sums[s[long]] + np.uint64(n))
        out[long, 1 + k] = (h >> shift).astype(np.int64)
    return s, e, text, sentence, out


@dataclass
class Model:
    """Chosen features (ascending), their weights, and the bias of every sentence."""

    chosen: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
        out[self.chosen] = self.weight
        return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _chosen(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features whose share of toxic documents is above the base rate beyond chance, by the strength of that."""
    total = toxic + clean
    rate = n_toxic / (n_toxic + n_clean)
    expected = total * rate
    z = (toxic - expected) / np.sqrt(np.maximum(expected * (1 - rate), 1e-9))
    good = np.flatnonzero((toxic >= 3) & (z > 4))
    return np.sort(good[np.argsort(-z[good], kind="stable")[:FEATURES]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros((2, 1 << FEATURE_BITS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy()
        raw, off = textnum.buffers(batch.column(0))
        for i, j, data, own in textnum.blocks(raw, off):
            docs += np.bincount(label[i:j], minlength=2)
            _, _, text, _, found = features(data, own)
            key = np.unique((text[:, None] << FEATURE_BITS | found)[found >= 0])
            feature, of = key & ((1 << FEATURE_BITS) - 1), label[i:j][key >> FEATURE_BITS]
            for y in (0, 1):
                np.add.at(counts[y], feature[of == y], 1)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([counts.tobytes()], pa.binary()), "docs": pa.array([docs.tobytes()], pa.binary())})


def _add(rows: pa.Table) -> pa.Table:
    out = {c: pa.array([sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column(c)).tobytes()], pa.binary()) for c in ("counts", "docs")}
    return pa.table(out)


def _bags(batches: Iterator[pa.RecordBatch], chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each document its label, its number of sentences, and the chosen features by sentence."""
    place = np.full((1 << FEATURE_BITS) + 1, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    for batch in batches:
        label = batch.column(1).to_numpy()
        raw, off = textnum.buffers(batch.column(0))
        for i, j, data, own in textnum.blocks(raw, off):
            _, _, text, sentence, found = features(data, own)
            last = np.zeros(j - i, np.int64)
            if len(text):
                edge = np.flatnonzero(np.append(sentence[1:] != sentence[:-1], True))
                last = np.bincount(text[edge], minlength=j - i)
            at = place[found]
            w, k = np.nonzero(at >= 0)
            key = np.unique(np.stack([text[w], sentence[w], at[w, k]], 1), axis=0).astype(np.int32) if len(w) else np.zeros((0, 3), np.int32)
            yield pa.RecordBatch.from_pydict(
                {"labels": pa.array([label[i:j].astype(np.int32).tobytes()], pa.binary()), "sentences": pa.array([last.tobytes()], pa.binary()), "hits": pa.array([key.tobytes()], pa.binary())}
            )


def fit(label: np.ndarray, sentences: np.ndarray, hits: np.ndarray, chosen: np.ndarray) -> Model:
    """Climb the likelihood of the noisy-or.  ``hits``: rows (document, sentence, feature); weights stay >= 0."""
    n = len(chosen)
    if not label.any() or label.all() or not n:
        rate = float(np.clip(label.mean() if len(label) else 0, 0, 1 - 1e-9))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(rate, 1e-12) / (1 - rate))))
    pairs, sent = np.unique(hits[:, 0].astype(np.int64) << 32 | hits[:, 1], return_inverse=True)
    doc = (pairs >> 32).astype(np.int64)
    feature = hits[:, 2]
    silent = sentences - np.bincount(doc, minlength=len(label))
    w, b = np.full(n, 1.0), -7.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sent, w[feature], minlength=len(pairs))
        u = np.bincount(doc, _softplus(z), minlength=len(label)) + silent * _softplus(b) + 1e-9
        du = np.where(label == 1, 1 / np.expm1(np.maximum(u, 1e-9)), -1.0)
        gz = du[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(feature, gz[sent], minlength=n), gz.sum() + (du * silent).sum() / (1 + np.exp(-b)))
        g[:n] -= PENALTY * len(label) / 1000 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = np.maximum(0, w + move[:n])
        b += move[n]
    return Model(chosen, w, float(b))


def trained(docs: DataFrame, labels: DataFrame, owner: str = "toxicity") -> Model:
    """``docs``: doc_id, text; ``labels``: doc_id, toxic (only rows that may be learned from)."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    # A share of the hash range holds about FIT_DOCS rows, so what is ordered and cut is no more than that.
    share = FIT_DOCS / max(1, known.count())
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    sample = some.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_DOCS)
    # FIT_DOCS rows of 16 bytes at most: a proven bound.
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    texts = scratch.written(texts, owner)
    sums = texts.mapInArrow(_count, "counts binary, docs binary").groupBy().applyInArrow(_add, "counts binary, docs binary").first()
    n_clean, n_toxic = (int(x) for x in np.frombuffer(sums["docs"], np.int64)) if sums is not None else (0, 0)
    if not n_clean + n_toxic:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int32), np.zeros(0, np.int64))
    clean, toxic = np.frombuffer(sums["counts"], np.int64).reshape(2, -1)
    chosen = _chosen(toxic, clean, n_toxic, n_clean) if n_toxic and n_clean else np.zeros(0, np.int64)
    bags = texts.mapInArrow(lambda b: _bags(b, chosen), "labels binary, sentences binary, hits binary").collect()
    label = [np.frombuffer(r["labels"], np.int32) for r in bags]
    base = np.cumsum([0, *map(len, label)])
    hits = [np.frombuffer(r["hits"], np.int32).reshape(-1, 3) + np.array([k, 0, 0], np.int32) for r, k in zip(bags, base, strict=False)]
    # Sentences are numbered by block: (document, sentence) names one, as no document is in two blocks.
    sentences = np.concatenate([np.frombuffer(r["sentences"], np.int64) for r in bags])
    return fit(np.concatenate(label), sentences, np.concatenate(hits), chosen)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    table = model.table()
    quiet = float(_softplus(model.bias))
    for batch in batches:
        score, count, worst = np.zeros(len(batch)), np.zeros(len(batch), np.int64), [None] * len(batch)
        raw, off = textnum.buffers(batch.column(1))
        for i, j, data, own in textnum.blocks(raw, off):
            s, e, text, sentence, found = features(data, own)
            if not len(s):
                score[i:j] = 1 - np.exp(-1e-9)
                continue
            hit = table[found]  # -1 reads the last entry, which is 0
            any_hit = np.flatnonzero(hit.any(axis=1))
            first = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
            last = np.append(first[1:], len(s)) - 1
            z = np.full(len(first), model.bias)
            if len(any_hit):
                # A feature counts once a sentence.
                w, k = np.nonzero(hit[any_hit] != 0)
                key = np.unique(sentence[any_hit[w]].astype(np.int64) << FEATURE_BITS | found[any_hit[w], k])
                np.add.at(z, key >> FEATURE_BITS, table[key & ((1 << FEATURE_BITS) - 1)])
            of = text[first]
            u = np.bincount(of, _softplus(z), minlength=j - i) + 1e-9
            score[i:j] = -np.expm1(-u)
            count[i:j] = np.bincount(of, minlength=j - i)
            if len(any_hit):
                top = np.lexsort((-z, of))
                lead = top[np.append(True, of[top][1:] != of[top][:-1])]
                for k in lead[_softplus(z[lead]) > 2 * quiet].tolist():
                    worst[i + of[k]] = data[s[first[k]] : e[last[k]]].tobytes().decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), pa.array(worst, pa.string())],
            ["doc_id", "held_out", "score", "predicted", "n_sentences", "worst_sentence"],
        )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, number of sentences, and the sentence that offends most (null if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(
        lambda b: _scores(b, shared.value), "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_sentence string"
    )


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents")
    labels = scratch.table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return scored(docs, trained(docs, labels, "op9"))
