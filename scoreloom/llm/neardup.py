"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles (operator 1).

1. Document frequencies of 5-word shingles go into a counter table of fixed size (2**20 counters, 4 MB whatever the
   input), summed per task before it moves.  A shingle weighs tf * idf; idf lies between 1 and 1.25.
2. Improved consistent weighted sampling draws 36 samples per text: two texts agree in a sample with a probability
   equal to their weighted Jaccard similarity.  Three samples make a band; 12 bands.  At similarity 0.8 a pair
   shares no band with probability 1.8e-4, at 0.9 with 2e-7.
3. Equal texts are one node.  In large buckets the pairs that share shingles which few nodes have are found by those;
   all other pairs can only share the rest, and those whose rest cannot come to 0.8 are left out (exactly).
4. In each bucket the node with the least of its own is compared with every other one; pairs that reach a weighted
   Jaccard similarity of 0.8 over the full texts are links, and links make classes.  Buckets that still hold two
   classes go on with more leaders (the share 8 / size of the bucket by hash, then 64 / size, ...) against all nodes
   of other classes, until every two nodes of a bucket have been compared or are in one class.  A group of k near
   copies so costs about k comparisons, no bucket is capped or ordered as a whole, and nothing is collected.
5. Classes are joined by contraction: every node hooks to its smallest neighbour, links are rewritten to the roots,
   and what became a loop or a copy goes, so that the rows of a step follow the nodes that are left.

Defined results: null text is empty; a text without words is its own class; a text of 1 to 4 words is one shingle;
a null doc_id is replaced by 2**62 and more, from a hash of the text, and comes after all others; rows that share
doc_id and text are one document, of which ``deduplicated`` keeps one row; rows that share a doc_id but not the text
are documents of their own; empty tables give empty results; the smallest id of a class stays, and of equal ids the
text with the smaller digest; no column of the input clashes with a name used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, textnum

SIMILARITY = 0.8
BANDS, ROWS = 12, 3
COUNTER_BITS = 20
SLICES = 64
#: Bits (2**25, 4 MB whatever the input) that tell which rows may be gone.
GONE_BITS = 25
#: Compressed texts that are opened at a time.
OPENED = 64
#: Growth of the number of leaders of a bucket from one round to the next.
ROUND_GROWTH = 8
#: From this size on a bucket is worth counting what its nodes share.  Shingles that so many nodes have are rare.
LARGE, RARE = 8, 4
#: idf lies between 1 and 1 + this: wider, and one changed word would weigh more than the words around it.
IDF_RANGE = 0.25
_KEYS = np.random.default_rng(77).integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64)
_TINY = np.float32(2.0**-33)


def node_id(doc_id: Column, text: Column) -> Column:
    hashed = F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 61))
    return F.coalesce(doc_id.cast("long"), hashed)


def _count_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTER_BITS, np.int64)
    texts = 0
    for batch in batches:
        raw, off = textnum.buffers(batch.column(0))
        for _, _, data, own in textnum.blocks(raw, off):
            h, t, _ = textnum.counted(*textnum.shingles(data, own))
            counts += np.bincount((h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(counts)) if len(h) > 4096 else 0
            if 0 < len(h) <= 4096:
                np.add.at(counts, (h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            texts += len(np.unique(t))
    if texts:
        parts = [*np.split(counts, SLICES), np.array([texts])]
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(range(SLICES + 1), pa.int32()), "counts": pa.array([p.astype(np.int64).tobytes() for p in parts], pa.binary())}
        )


def _sum_slices(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw.as_py(), np.int64) for raw in rows.column("counts"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf by counter: 1 + IDF_RANGE * ln((n + 1) / (df + 1)) / ln(n + 2), df less the table's background of rare shingles.

    What comes to the driver is the counter table, 8 MB for any input.
    """
    parts = docs.select("text").mapInArrow(_count_shingles, "slice int, counts binary")
    rows = parts.groupBy("slice").applyInArrow(_sum_slices, "slice int, counts binary").collect()
    if not rows:
        return np.full(1 << COUNTER_BITS, 1 + IDF_RANGE, np.float32)
    by = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in rows}
    counts = np.concatenate([by[k] for k in range(SLICES)])
    n = int(by[SLICES][0])
    seen = np.clip(counts - np.median(counts), 0, n)
    return (1 + IDF_RANGE * np.log((n + 1) / (seen + 1)) / np.log(n + 2)).astype(np.float32)


def _weighted(data: np.ndarray, off: np.ndarray, idf: np.ndarray):
    h, t, n = textnum.counted(*textnum.shingles(data, off))
    return h, t, n.astype(np.float32) * idf[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]


def _uniforms(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    high, low = (z >> np.uint64(32)).astype(np.float32), (z & np.uint64(0xFFFFFFFF)).astype(np.float32)
    scale = np.float32(2.0**-32)
    return high * scale + _TINY, low * scale + _TINY


def samples(h: np.ndarray, first: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The k-th sample of each text as one hash; ``first``: where each text's shingles begin.

    r, c ~ Gamma(2, 1), beta ~ U(0, 1) from the shingle; t = floor(ln w / r + beta); the sample is the (shingle, t)
    with the least ln c - r (t - beta + 1).
    """
    z = (h ^ _KEYS[k, 0]) * np.uint64(0x9E3779B97F4A7C15)
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    y = (z ^ _KEYS[k, 1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    y ^= y >> np.uint64(31)
    u1, u2 = _uniforms(z)
    v1, v2 = _uniforms(y)
    r = -np.log(u1 * u2)
    c = -np.log(v1 * v2)
    beta = (((z * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)).astype(np.float32)) * np.float32(2.0**-24)
    t = np.floor(np.log(weight) / r + beta)
    a = np.log(c) - r * (t - beta + 1)
    least = np.minimum.reduceat(a, first)
    counts = np.diff(np.append(first, len(a)))
    hits = np.flatnonzero(a == np.repeat(least, counts))
    at = hits[np.searchsorted(hits, first)]
    return textnum.mix(h[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _signatures(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = textnum.buffers(batch.column(2))
        keys = np.zeros((len(batch), BANDS), np.uint64)
        total = np.zeros(len(batch))
        for i, j, data, own in textnum.blocks(raw, off):
            h, t, w = _weighted(data, own, idf)
            if not len(h):
                continue
            texts, first = np.unique(t, return_index=True)
            total[i:j] = np.bincount(t, w, minlength=j - i)
            for band in range(BANDS):
                key = np.full(len(texts), band + 1, np.uint64)
                for k in range(ROWS):
                    key = textnum.mix(key ^ samples(h, first, w, band * ROWS + k))
                keys[i + texts, band] = key
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(batch) + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands, pa.array(total)], ["id", "digest", "bands", "weight"])


def _opened(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows i to j of a column of compressed texts."""
    texts = textnum.expanded(column.slice(i, j - i))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _similarities(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.zeros(len(batch))
        for i in range(0, len(batch), OPENED):
            j = min(i + OPENED, len(batch))
            parts = [_weighted(*_opened(column, i, j), idf) for column in (batch.column(2), batch.column(3))]
            h, t, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((h, t))
            h, t, w = h[order], t[order], w[order].astype(np.float64)
            both = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1]))
            shared = np.bincount(t[both], np.minimum(w[both], w[both + 1]), minlength=j - i)
            whole = np.bincount(t, w, minlength=j - i) - shared
            found[i:j] = shared / np.maximum(whole, 1e-12)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "similarity"])


def _hooked(edges: DataFrame, owner: str) -> DataFrame:
    """(node, root): every node hooks to its smallest neighbour, then pointers are halved until all are at a root."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), owner)
    while True:
        up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        new = hooks.join(up, hooks["root"] == up["_n"]).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved"))
        new = scratch.written(new, owner)
        hooks = new.select("node", "root")
        if new.filter("moved").isEmpty():
            return hooks


def _rewritten(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the roots of their ends: no loops, each once."""
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("_b"))
    ends = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
    return ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _composed(roots: DataFrame | None, hooks: DataFrame, owner: str) -> DataFrame:
    """(node, root) after the roots themselves have got the roots ``hooks``."""
    if roots is None:
        return hooks
    up = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = roots.join(up, roots["root"] == up["_n"], "left").select("node", F.coalesce("_r", "root").alias("root"))
    return scratch.written(moved.union(hooks.join(roots, "node", "left_anti")), owner)


def components(links: DataFrame, owner: str, roots: DataFrame | None = None) -> DataFrame:
    """(node, root) of every linked node, root the smallest node of its class; ``roots``: the classes of earlier links."""
    edges = _rewritten(links, roots) if roots is not None else links.select("a", "b").distinct()
    edges = scratch.written(edges, owner)
    while roots is None or not edges.isEmpty():
        hooks = _hooked(edges, owner)
        roots = _composed(roots, hooks, owner)
        edges = scratch.written(_rewritten(edges, hooks), owner)
    return roots


def _nodes(signed: DataFrame, owner: str) -> DataFrame:
    """(digest, first, node): every text with its smallest id; the node is that id, or where rows of other texts or
    repeated rows share it, a hash of both."""
    firsts = signed.groupBy("digest").agg(F.min("id").alias("first"))
    twice = signed.groupBy(F.col("id").alias("first")).agg(F.count("*").alias("rows")).filter("rows > 1")
    hashed = F.lit(1 << 62) + F.pmod(F.xxhash64("first", "digest"), F.lit(1 << 61))
    return scratch.written(firsts.join(twice, "first", "left").select("digest", "first", F.when(F.col("rows").isNull(), F.col("first")).otherwise(hashed).alias("node")), owner)


def _texts(base: DataFrame, wanted: DataFrame, repeats: bool, owner: str) -> DataFrame:
    """(node, text), one row a node.  Texts are compressed before they move, as they do so several times, and read where
    two of them meet.  Rows that share id and text are summed up before they move."""
    rows = base.select("id", "digest", F.arrow_udf(textnum.squeezed, "binary")("text").alias("text"))
    rows = rows.dropDuplicates(["id", "digest"]) if repeats else rows
    return scratch.written(rows.join(wanted, ["id", "digest"]).select("node", "text"), owner)


def _repeats(signed: DataFrame, owner: str) -> DataFrame:
    """(id, digest) that more than one row has."""
    return scratch.written(signed.groupBy("id", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("id", "digest"), owner)


def _base(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(node_id(F.col("doc_id"), F.col("text")).alias("id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"), "doc_id")


def _worded(text: Column) -> Column:
    return text.rlike("[^\\x20\\x09-\\x0D]")


def _signed(docs: DataFrame, idf, owner: str) -> DataFrame:
    signed = _base(docs).select("id", "digest", "text").mapInArrow(
        lambda b: _signatures(b, idf.value), "id long, digest string, bands array<long>, weight double"
    )
    return scratch.written(signed, owner)


def classes(docs: DataFrame, owner: str = "neardup", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: id, doc_id, class_id (the smallest id of its class) and kept (it stands for its class)."""
    return _classes(docs, owner, similarity)[0]


def _classes(docs: DataFrame, owner: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows with their class, and (id, digest) of those that come more than once."""
    base = _base(docs)
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs))
    signed = _signed(docs, idf, owner)
    repeats = _repeats(signed, owner)
    nodes = _nodes(signed, owner)
    reps = signed.filter("weight > 0").join(nodes, (signed["digest"] == nodes["digest"]) & (signed["id"] == nodes["first"]))
    keys = reps.select("node", "weight", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sized = scratch.written(keys.join(shared, "key"), owner)
    roots = None
    if not sized.isEmpty():
        wanted = nodes.join(sized.select("node").distinct(), "node").select(F.col("first").alias("id"), "digest", "node")
        texts = _texts(base, wanted, not repeats.isEmpty(), owner)
        roots = _linked(sized, texts, idf, owner, similarity)
    return _by_document(base.select("id", "digest", "doc_id", _worded(F.col("text")).alias("worded")), nodes, roots), repeats


def _linked(sized: DataFrame, texts: DataFrame, idf, owner: str, similarity: float) -> DataFrame | None:
    """(node, root) of the nodes that are linked to others, or None."""
    # own: weight of what few other nodes of large buckets have; it bounds every similarity inside large buckets.
    own, near = _rare(sized, texts, idf, owner, similarity)
    rows = sized.join(own, "node", "left").withColumn("own", F.when(F.col("size") >= LARGE, F.coalesce("own", F.lit(0.0))).otherwise(0.0))
    left = rows.filter(F.col("weight") - F.col("own") >= (similarity - 1e-6) * F.col("weight"))
    # u: a place in [0, 1) for each node of a bucket.
    u = F.shiftrightunsigned(F.xxhash64("key", "node"), 1) / F.lit(float(1 << 63))
    left = scratch.written(left.select("key", "size", "node", "weight", "own", u.alias("u")), owner)
    tested = roots = None
    leaders = 0
    while True:
        pairs = _first_pairs(left, similarity).union(near).distinct() if not leaders else _more_pairs(left, leaders, similarity)
        pairs = scratch.written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), owner)
        if not pairs.isEmpty():
            # Only texts that stand in a pair of this round move; a later round has few of them.
            named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            held = texts.join(named, "node", "left_semi")
            one, two = held.withColumnsRenamed({"node": "a", "text": "text_a"}), held.withColumnsRenamed({"node": "b", "text": "text_b"})
            full = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
            scored = full.mapInArrow(lambda b: _similarities(b, idf.value), "a long, b long, similarity double")
            found = scratch.written(scored.filter(F.col("similarity") >= similarity).select("a", "b"), owner)
            tested = pairs if tested is None else tested.union(pairs)
            if not found.isEmpty():
                roots = components(found, owner, roots)
        # Go on with the nodes of buckets that hold two classes and have nodes that have not led.
        left = left.drop("root").filter(F.col("size") > leaders)
        known = left.withColumn("root", F.col("node")) if roots is None else left.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        left = scratch.written(known.join(mixed, "key", "left_semi"), owner)
        if left.isEmpty():
            return roots
        leaders = max(1, leaders) * ROUND_GROWTH


def _rare(sized: DataFrame, texts: DataFrame, idf, owner: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """For nodes in large buckets: (node, own), the weight of their shingles that at most RARE such nodes have, and
    (a, b), the pairs that share such shingles and may be similar.  A shingle makes at most RARE (RARE - 1) / 2 pairs.
    """
    large = sized.filter(F.col("size") >= LARGE).select("node", "weight").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i in range(0, len(batch), OPENED):
                h, t, w = _weighted(*_opened(batch.column(1), i, min(i + OPENED, len(batch))), idf.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + t]), pa.array(h.view(np.int64)), pa.array(w.astype(np.float64))], ["node", "h", "w"])

    held = texts.join(large.select("node"), "node", "left_semi").mapInArrow(spread, "node long, h long, w double")
    held = scratch.written(held, owner)
    counted = held.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("w").alias("w"))
    alone = counted.filter("n = 1").select("node", "w")
    some = held.join(counted.filter(F.col("n").between(2, RARE)).select("h"), "h").select("h", "node", "w")
    own = scratch.written(alone.union(some.select("node", "w")).groupBy("node").agg(F.sum("w").alias("own")), owner)
    other = some.select("h", F.col("node").alias("b"), F.col("w").alias("v"))
    both = some.join(other, "h").filter(F.col("node") < F.col("b")).groupBy(F.col("node").alias("a"), "b").agg(F.sum(F.least("w", "v")).alias("shared"))
    full = large.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    left = full.select(F.col("node").alias("a"), F.col("weight").alias("wa"), F.col("own").alias("oa"))
    right = full.select(F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("own").alias("ob"))
    most = F.col("shared") + F.least(F.col("wa") - F.col("oa"), F.col("wb") - F.col("ob"))
    may = most >= (similarity - 1e-6) * (F.col("wa") + F.col("wb") - most)
    return own, both.join(left, "a").join(right, "b").filter(may).select("a", "b")


def _may(own_a: str, weight_a: str, own_b: str, weight_b: str, similarity: float) -> Column:
    """Whether two texts that share nothing rare may be similar.

    They share at most m, the smaller of what either has beside its rare shingles, and so have a similarity of at
    most m / (weight + weight - m).  Those that do share rare shingles come from ``_rare``.
    """
    most = F.least(F.col(weight_a) - F.col(own_a), F.col(weight_b) - F.col(own_b))
    return most >= (similarity - 1e-6) * (F.col(weight_a) + F.col(weight_b) - most)


def _ordered() -> list[Column]:
    return [F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")]


def _first_pairs(left: DataFrame, similarity: float) -> DataFrame:
    """In each bucket the node with the least share of its own, beside every other one: one row a node."""
    order = F.shiftleft(F.least(F.floor(10 * F.col("own") / F.col("weight")), F.lit(9)).cast("long"), 59) + F.shiftrightunsigned(F.xxhash64("key", "node"), 5)
    lead = left.groupBy("key").agg(*[F.min_by(c, order).alias(n) for c, n in (("node", "a"), ("weight", "w"), ("own", "o"))])
    return left.join(lead, "key").filter((F.col("node") != F.col("a")) & _may("own", "weight", "o", "w", similarity)).select(*_ordered())


def _more_pairs(left: DataFrame, leaders: int, similarity: float) -> DataFrame:
    """Pairs of a leader with the nodes of other classes that come after it: leaders are the nodes whose place lies in
    the next range of about ``leaders`` nodes."""
    since, upto = F.lit(leaders // ROUND_GROWTH if leaders > ROUND_GROWTH else 0), F.lit(leaders)
    lead = left.filter((F.col("u") * F.col("size") >= since) & (F.col("u") * F.col("size") < upto)).select(
        "key", F.col("node").alias("a"), F.col("u").alias("v"), F.col("weight").alias("w"), F.col("own").alias("o"), F.col("root").alias("r")
    )
    after = (F.col("u") > F.col("v")) | ((F.col("u") == F.col("v")) & (F.col("node") > F.col("a")))
    joined = left.join(lead, "key").filter(after & (F.col("root") != F.col("r")) & _may("own", "weight", "o", "w", similarity))
    return joined.select(*_ordered()).distinct()


def _by_document(base: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    own = F.struct("first", "digest")
    if roots is None:
        of = nodes.select("digest", own.alias("best"))
    else:
        linked = nodes.join(roots, "node")
        best = linked.groupBy("root").agg(F.min(own).alias("best"))
        of = nodes.join(roots, "node", "left").join(best, "root", "left").select("digest", F.coalesce("best", own).alias("best"))
    joined = base.join(of, "digest")
    # Texts without words may be equal, but no document of them stands for another.
    alone = ~F.col("worded")
    stands = alone | ((F.col("id") == F.col("best.first")) & (F.col("digest") == F.col("best.digest")))
    return joined.select("id", "digest", "doc_id", F.when(alone, F.col("id")).otherwise(F.col("best.first")).alias("class_id"), stands.alias("kept"))


def _marked_bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << (size - 3), np.uint8)
    for batch in batches:
        at, bit = _bit(batch.column(0), size)
        np.bitwise_or.at(bits, at, bit)
    if bits.any():
        parts = [part.tobytes() for part in np.split(bits, SLICES)]
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "bits": pa.array(parts, pa.binary())})


def _bit(hashed: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashed.to_numpy(zero_copy_only=False).astype(np.int64) & ((1 << size) - 1)
    return h >> 3, np.left_shift(1, h & 7).astype(np.uint8)


def _either_slice(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    either = np.bitwise_or.reduce([np.frombuffer(raw.as_py(), np.uint8) for raw in rows.column("bits")])
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([either.tobytes()], pa.binary())})


def _may_be(keys: DataFrame, size: int = GONE_BITS) -> Column:
    """Whether a row's (id, digest) may be one of ``keys``: never false for one of them.  Rows of which it is false need not
    move to meet the keys.  What comes to the driver is the table of bits."""
    hashed = F.xxhash64("id", "digest")
    parts = keys.select(hashed.alias("h")).mapInArrow(lambda b: _marked_bits(b, size), "slice int, bits binary")
    by = {r["slice"]: r["bits"] for r in parts.groupBy("slice").applyInArrow(_either_slice, "slice int, bits binary").collect()}
    empty = bytes((1 << (size - 3)) // SLICES)
    bits = keys.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(by.get(k, empty) for k in range(SLICES)), np.uint8))

    def among(h: pa.Array) -> pa.Array:
        at, bit = _bit(h, size)
        return pa.array((bits.value[at] & bit) != 0)

    return F.arrow_udf(among, "boolean")(hashed)


def _without(rows: DataFrame, gone: DataFrame, size: int = GONE_BITS) -> DataFrame:
    """``rows`` whose (id, digest) is not in ``gone``.  Only those that may be gone move."""
    marked = rows.withColumn("_may", _may_be(gone, size))
    return marked.filter(~F.col("_may")).unionByName(marked.filter("_may").join(gone, ["id", "digest"], "left_anti")).drop("_may")


def deduplicated(docs: DataFrame, owner: str = "neardup") -> DataFrame:
    """``docs`` with one row of each class, of the document with the smallest id; all columns stay."""
    found, repeats = _classes(docs, owner, SIMILARITY)
    gone = scratch.written(found.filter(~F.col("kept")).select("id", "digest").distinct(), owner)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), node_id(F.col("doc_id"), F.col("text")).alias("id"), F.md5(text.cast("binary")).alias("digest"))
    rows = _without(rows, gone)
    if not repeats.isEmpty():
        once = rows.join(repeats, ["id", "digest"], "left_anti")
        rows = once.unionByName(rows.join(repeats, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]))
    return rows.select("row.*")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = scratch.table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, "op1").select("doc_id", "class_id", "kept")
