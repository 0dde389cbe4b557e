"""Nearest vectors by inner product with multiprobe p-stable hashing (operator 6).

Inner products become Euclidean distances by one more coordinate, sqrt(1 - |x|^2 / M^2) for rows and 0 for queries
(M: the largest norm).  Each of TABLES hash tables takes HASHES values floor((a.x + b) / w).  The width w is fitted on
a bounded sample: WIDTH_FACTOR times the distance at which the wanted neighbours stand.  A query visits its own bucket and then perturbed ones in the order of estimated success: the sum of squared distances to the
boundaries crossed, in the sequence of sets that is best on average.  The candidates of all tables are merged and
ranked by the exact inner product.

Rows are indexed in packed blocks of equal size, so that copies of one vector spread over tasks; every block of
queries meets every block of rows by an equality join on the block's number, and gives back its best K a query.
Inside, only the rows in visited buckets are multiplied; where these are most of the block, all of it is, at once.

Recall: random directions in 64 dimensions have no near neighbours to speak of (the 20th of 50,000 stands at cosine
0.41, the nearest at 0.5), so they are visited by three in four; of clustered vectors, one in a hundred is.  The README
has the measured figures.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part; rows that share the query's vec_id are its own; repeated query rows count once; ties go to
the smaller vec_id; an empty table gives an empty result; null ids take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

TABLES, HASHES, PROBES = 8, 8, 200
#: The width of a bucket by the distance of the last wanted neighbour (for nine in ten of the sampled queries).
WIDTH_FACTOR = 1.7
#: The sample that the width is fitted on: rows, their bytes, and how many of them are queries.
FIT_ROWS, FIT_BYTES, FIT_QUERIES = 4096, 32_000_000, 64
NEIGHBOURS = 20
BLOCK_ROWS = 4096
QUERY_ROWS = 512
SEED = 11


def usable(v: Column) -> Column:
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def probe_sequence(hashes: int, probes: int) -> np.ndarray:
    """Perturbation sets over the 2 * hashes boundaries sorted by distance, best first by expected squared distance.

    Row k of the result has ones where set k takes a boundary; boundaries j and 2 * hashes - 1 - j belong to one hash.
    """
    m = hashes
    j = np.arange(1, 2 * m + 1)
    z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    out = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < probes:
        cost, s = heapq.heappop(heap)
        if all(2 * m - 1 - x not in s for x in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*s, last + 1)))
    sets = np.zeros((len(out), 2 * m), np.int8)
    for k, s in enumerate(out):
        sets[k, list(s)] = 1
    return sets


class Index:
    """The hash functions: fixed by dimension, scale and width, so every task has the same."""

    def __init__(self, dim: int, scale: float, width: float):
        rng = np.random.default_rng(SEED)
        self.dim, self.scale, self.width = dim, scale, width
        self.a = rng.normal(size=(TABLES, HASHES, dim + 1))
        self.b = rng.uniform(0, width, (TABLES, HASHES))
        self.factors = rng.integers(1, 1 << 63, (TABLES, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.sets = probe_sequence(HASHES, PROBES)

    def _projected(self, points: np.ndarray, table: int) -> np.ndarray:
        return (points @ self.a[table].T + self.b[table]) / self.width

    def _bucket(self, values: np.ndarray, table: int) -> np.ndarray:
        h = (values.astype(np.int64).astype(np.uint64) * self.factors[table]).sum(-1, dtype=np.uint64)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Buckets of rows, by table."""
        x = x / self.scale
        points = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])
        return np.stack([self._bucket(np.floor(self._projected(points, t)), t) for t in range(TABLES)])

    def probes(self, q: np.ndarray) -> np.ndarray:
        """Buckets that queries visit: (table, query, probe), in order."""
        points = np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])
        out = []
        for t in range(TABLES):
            y = self._projected(points, t)
            base = np.floor(y)
            part = y - base
            order = np.argsort(np.hstack([part, 1 - part]), axis=1, kind="stable")
            hash_of, step = order % HASHES, np.where(order < HASHES, -1, 1)
            moves = np.zeros((len(q), 2 * HASHES, HASHES), np.int8)
            np.put_along_axis(moves, hash_of[:, :, None], step[:, :, None].astype(np.int8), axis=2)
            shifts = np.einsum("pj,qjh->qph", self.sets.astype(np.float32), moves.astype(np.float32))
            out.append(self._bucket(base[:, None, :] + shifts, t))
        return np.stack(out)


def fitted_width(sample: np.ndarray, scale: float, n: int, k: int) -> float:
    """The width for a table of n rows from a sample of them: in m rows, the k-th of n stands about at k * m / n."""
    m = len(sample)
    if m < 2:
        return 1.0
    q = sample[:FIT_QUERIES]
    cosine = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (sample / scale).T
    distance = np.sqrt(np.maximum(0, 2 - 2 * cosine))
    distance[np.arange(len(q)), np.arange(len(q))] = np.inf
    rank = min(max(1, round(k * m / n)), m - 1)
    at = np.quantile(np.partition(distance, rank - 1, axis=1)[:, rank - 1], 0.9)
    return WIDTH_FACTOR * max(float(at), 1e-3)


def visits(buckets: np.ndarray, probes: np.ndarray):
    """For one table: rows of the block in order of bucket, and (query, first, number) of the runs that are visited."""
    order = np.argsort(buckets, kind="stable")
    known, first, number = np.unique(buckets[order], return_index=True, return_counts=True)
    place = np.minimum(np.searchsorted(known, probes), len(known) - 1)
    query, probe = np.nonzero(known[place] == probes)
    run = place[query, probe]
    return order, query, first[run], number[run]


def candidates(buckets: np.ndarray, probes: np.ndarray, rows: int, queries: int) -> tuple[np.ndarray, np.ndarray] | np.ndarray:
    """(query, row) of every row in a visited bucket, each once; as a mask where they are many."""
    found = [visits(buckets[t], probes[t]) for t in range(TABLES)]
    if sum(int(number.sum()) for *_, number in found) > rows * queries // 4:
        mask = np.zeros((queries, rows), bool)
        for order, query, first, number in found:
            begin = np.cumsum(number) - number
            mask[np.repeat(query, number), order[np.repeat(first - begin, number) + np.arange(int(number.sum()))]] = True
        return mask
    codes = []
    for order, query, first, number in found:
        begin = np.cumsum(number) - number
        codes.append(np.repeat(query, number) * rows + order[np.repeat(first - begin, number) + np.arange(int(number.sum()))])
    code = np.unique(np.concatenate(codes))
    return code // rows, code % rows


def nearest_in_block(ids: np.ndarray, x: np.ndarray, buckets: np.ndarray, query_ids, q, probes, k: int):
    """(query, vec, score) of each query's k best candidates in one block of rows."""
    at = candidates(buckets, probes, len(x), len(q))
    if isinstance(at, tuple):
        at_q, at_v = at
        other = query_ids[at_q] != ids[at_v]
        at_q, at_v = at_q[other], at_v[other]
    else:
        at &= query_ids[:, None] != ids[None, :]
        scores = np.where(at, q @ x.T, -np.inf)
        # Everything that may tie with the k-th is scored again, each row by the same sum, before the cut.
        edge = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(q), -np.inf)
        floor = np.where(np.isfinite(edge), edge - 1e-9 * np.maximum(1, np.abs(edge)), -np.inf)
        at_q, at_v = np.nonzero((scores >= floor[:, None]) & at)
    exact = np.concatenate([(q[at_q[i : i + 65536]] * x[at_v[i : i + 65536]]).sum(1) for i in range(0, len(at_q), 65536)] or [np.zeros(0)])
    order = np.lexsort((ids[at_v], -exact, at_q))
    at_q, at_v, exact = at_q[order], at_v[order], exact[order]
    rank = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    keep = rank < k
    return query_ids[at_q[keep]], ids[at_v[keep]], exact[keep]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim).astype(np.float64)


def searched(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, owner: str = "ann") -> DataFrame:
    """query_id, rank, vec_id, score.  Both inputs: vec_id and embedding."""
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    base = scratch.written(clean(vectors), owner)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shape = base.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("scale")).orderBy(F.desc("n"), "dim").first()
    out = "query_id long, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, scale = shape["dim"], shape["n"], shape["scale"] * (1 + 1e-9)
    blocks = max(1, -(-n // BLOCK_ROWS))
    same = base.filter(F.size("embedding") == dim)
    fit = same.orderBy(F.xxhash64("vec_id", F.hash("embedding"))).limit(max(2, min(FIT_ROWS, FIT_BYTES // (8 * dim)))).select("embedding").collect()
    width = fitted_width(np.array([r[0] for r in fit], np.float64), scale, n, k)

    def pack_rows(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x = _matrix(rows.column("embedding").combine_chunks(), dim)
        ids = rows.column("vec_id").to_numpy()
        buckets = Index(dim, scale, width).rows(x)
        return pa.table({"block": [key[0].as_py()], "ids": [ids.tobytes()], "rows": [x.astype(np.float64).tobytes()], "buckets": [buckets.tobytes()]},
                        schema=pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("rows", pa.binary()), ("buckets", pa.binary())]))

    def pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(dim, scale, width)
        for batch in batches:
            for i in range(0, len(batch), QUERY_ROWS):
                part = batch.slice(i, QUERY_ROWS)
                q = _matrix(part.column(1), dim)
                yield pa.RecordBatch.from_pydict({
                    "q_ids": pa.array([part.column(0).to_numpy().tobytes()], pa.binary()),
                    "q_rows": pa.array([q.tobytes()], pa.binary()),
                    "probes": pa.array([index.probes(q).tobytes()], pa.binary()),
                })

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                qid = np.frombuffer(r["q_ids"], np.int64)
                found = nearest_in_block(
                    ids, np.frombuffer(r["rows"]).reshape(-1, dim), np.frombuffer(r["buckets"], np.uint32).reshape(TABLES, -1),
                    qid, np.frombuffer(r["q_rows"]).reshape(-1, dim), np.frombuffer(r["probes"], np.uint32).reshape(TABLES, len(qid), -1), k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    number = F.pmod(F.xxhash64("vec_id", F.hash("embedding")), F.lit(blocks)).cast("int")
    packed = same.withColumn("block", number).groupBy("block").applyInArrow(pack_rows, "block int, ids binary, rows binary, buckets binary")
    packed = scratch.written(packed, owner)
    asked = clean(queries).filter(F.size("embedding") == dim).dropDuplicates(["vec_id"])
    asked = scratch.written(asked, owner)
    packs = max(1, -(-asked.count() // QUERY_ROWS))
    asked = scratch.written(asked.repartition(packs, "vec_id").mapInArrow(pack_queries, "q_ids binary, q_rows binary, probes binary"), owner)
    # Every block of queries meets every block of rows: the join's key is the block of rows, where the search runs.
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = sent.join(packed, "block").select("ids", "rows", "buckets", "q_ids", "q_rows", "probes").mapInArrow(search, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_multiprobe_search(spark, sf_dir: str) -> DataFrame:
    vectors = scratch.table(spark, sf_dir, "embeddings")
    return searched(vectors, vectors.filter(F.col("vec_id") % 20 == 0), owner="op6")
