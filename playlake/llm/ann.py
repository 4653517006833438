"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, non_empty, saved
from .words import BASE_A, mixed

ARROW_ROWS = 4000
TABLES = 8
# Width of a hash's slots in standard deviations of the projections.
WIDTH = 1.2
# Rows of a bucket aimed at, on which the number of hashes of a table depends: it grows with the logarithm of the rows.
BUCKET_ROWS = 128
# Rows the scale of the projections is estimated from, and queries the number of probes is set by.
SAMPLE_ROWS, SAMPLE_QUERIES = 2_000, 64
RECALL = 0.97
MAX_PROBES = 1_024
# A bucket is searched in blocks of at most so many rows and queries, by expectation.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
# Queries whose nearest a task keeps before it passes them on.
TASK_QUERIES = 20_000
# Queries scanned together where too few neighbours were found.
EXACT_QUERIES = 512


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; of rows that repeat an id, the one with the least vector."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.coalesce(finite, F.lit(False))
                & F.exists("vec", lambda x: x != 0))
    return v.groupBy("id").agg(F.min("vec").alias("vec"))


def fit_hashes(sample: np.ndarray, rows: int, seed: int = 7) -> dict:
    """Gaussian projections and offsets for all tables, from a sample of vectors and the number of rows."""
    spread = float(np.sqrt(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    width = WIDTH * spread
    # entropy of a Gaussian in slots of that width, in bits
    bits = max(0.5, 0.5 * math.log2(2 * math.pi * math.e) - math.log2(WIDTH))
    hashes = int(min(24, max(2, round(math.log2(max(2.0, rows / BUCKET_ROWS)) / bits))))
    rng = np.random.default_rng(seed)
    return {"a": rng.standard_normal((TABLES, sample.shape[1], hashes)),
            "b": rng.uniform(0, width, (TABLES, 1, hashes)), "width": width}


def _places(x: np.ndarray, model: dict) -> np.ndarray:
    """Where each vector falls, in slots: (tables, rows, hashes)."""
    return (np.matmul(x[None], model["a"]) + model["b"]) / model["width"]


def _keys(codes: np.ndarray, table: int) -> np.ndarray:
    """64 bits that name the bucket of each row of ``codes`` (rows, hashes)."""
    key = np.full(len(codes), table + 1, np.uint64)
    for i in range(codes.shape[1]):
        key = mixed(key * BASE_A + codes[:, i].astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def probe_order(place: np.ndarray, probes: int) -> np.ndarray:
    """The codes of the ``probes`` buckets most likely to hold neighbours of a point, best first.

    A bucket differs from the point's own in some slots, each moved by 1 or
    2; its score is the sum of the squared distances to the moved slots.
    Hash by hash, the best so far are extended by all five moves and the best
    kept: scores only grow, so none of the best is lost.
    """
    own = np.floor(place).astype(np.int64)
    x = place - own
    moves = np.array([0, -1, 1, -2, 2])
    cost = np.stack([np.zeros_like(x), x, 1 - x, 1 + x, 2 - x], axis=1) ** 2
    score, codes = np.zeros(1), np.empty((1, 0), np.int64)
    for i in range(len(own)):
        s = (score[:, None] + cost[i]).ravel()
        keep = np.argsort(s, kind="stable")[:probes]
        score = s[keep]
        codes = np.concatenate([codes[keep // 5], (own[i] + moves[keep % 5])[:, None]], axis=1)
    return codes


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int):
    """For each query the places and squared distances of its ``k`` nearest rows, ties to smaller ids."""
    step = max(1, 1_000_000 // (x.shape[1] * max(1, len(q))))
    d2 = np.empty((len(q), len(x)))
    for i in range(0, len(x), step):  # differences, not products: equal vectors give equal distances
        d2[:, i:i + step] = ((q[:, None, :] - x[None, i:i + step]) ** 2).sum(axis=2)
    d2[own[:, None] == ids[None]] = np.inf
    for row in d2:
        if len(row) > k:
            at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1])
        else:
            at = np.arange(len(row))
        at = at[np.lexsort((ids[at], row[at]))][:k]
        at = at[np.isfinite(row[at])]
        yield at, row[at]


class _Best:
    """The nearest rows so far of the queries a task has met."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, query: int, ids: np.ndarray, d2: np.ndarray):
        if query in self.found:
            i0, d0 = self.found[query]
            ids, d2 = np.concatenate([i0, ids]), np.concatenate([d0, d2])
            ids, first = np.unique(ids, return_index=True)
            d2 = d2[first]
            at = np.lexsort((ids, d2))[:self.k]
            ids, d2 = ids[at], d2[at]
        self.found[query] = (ids, d2)

    def rows(self) -> pd.DataFrame:
        q = [np.full(len(i), query, np.int64) for query, (i, _) in self.found.items()]
        out = pd.DataFrame({"query_id": np.concatenate(q) if q else np.empty(0, np.int64),
                            "vec_id": np.concatenate([i for i, _ in self.found.values()]) if q else np.empty(0, np.int64),
                            "score": np.sqrt(np.concatenate([d for _, d in self.found.values()])) if q else np.empty(0)})
        self.found = {}
        return out


def _matrix(vec: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vec]) if len(vec) else np.empty((0, 0))


def _index(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                codes = np.floor(_places(_matrix(pdf["vec"]), model.value)).astype(np.int64)
                yield pd.concat([pd.DataFrame({"bucket": _keys(codes[t], t), "id": pdf["id"], "vec": pdf["vec"]})
                                 for t in range(len(codes))])
    return non_empty(run)


def _probes(model, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 64):
                part = pdf.iloc[i:i + 64]
                place = _places(_matrix(part["vec"]), model.value)
                out = []
                for t in range(len(place)):
                    for j, (query, vec) in enumerate(zip(part["id"], part["vec"])):
                        keys = _keys(probe_order(place[t, j], probes), t)
                        out.append(pd.DataFrame({"bucket": keys, "id": query, "vec": [vec] * len(keys)}))
                yield pd.concat(out)
    return non_empty(run)


def _search(k: int):
    """Partitions sorted by block, in each block the queries before the rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        block, queries, own = None, [], []
        for pdf in batches:
            names = pdf[["bucket", "rb", "qb"]].to_numpy()
            change = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *change], [*change, len(pdf)]):
                if block is None or (names[a] != block).any():
                    block, queries, own = names[a], [], []
                    if len(best.found) >= TASK_QUERIES:
                        yield best.rows()
                part = pdf.iloc[a:b]
                n = int((part["kind"] == 0).sum())
                queries += part["vec"].iloc[:n].tolist()
                own += part["id"].iloc[:n].tolist()
                if n < len(part) and queries:
                    x, ids = _matrix(part["vec"].iloc[n:]), part["id"].iloc[n:].to_numpy(np.int64)
                    q, mine = _matrix(queries), np.asarray(own, np.int64)
                    for i, (at, d2) in enumerate(_nearest(x, ids, q, mine, k)):
                        best.add(own[i], ids[at], d2)
        yield best.rows()
    return non_empty(run)


def _scan(block, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q = block.value
        best = _Best(k)
        for pdf in batches:
            if len(pdf):
                ids = pdf["id"].to_numpy(np.int64)
                x = _matrix(pdf["vec"])
                for i in range(0, len(q), 64):
                    for j, (at, d2) in enumerate(_nearest(x, ids, q[i:i + 64], own[i:i + 64], k)):
                        best.add(int(own[i + j]), ids[at], d2)
        yield best.rows()
    return non_empty(run)


RESULT = "query_id long, vec_id long, score double"


def _top(found: DataFrame, k: int) -> DataFrame:
    """Nearest first, ties to smaller ids; one row a candidate, though several tables found it."""
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    d = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_neighbours(rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The ``k`` nearest of ``rows`` (id, vec) for a block of queries, by one scan."""
    block = rows.sparkSession.sparkContext.broadcast((ids, vectors))
    return _top(rows.mapInPandas(_scan(block, k), RESULT), k)


def _probe_count(rows: DataFrame, sample: pd.DataFrame, model: dict, k: int) -> int | None:
    """The least number of probes with which the true neighbours of the sample are found often enough."""
    ids, q = sample["id"].to_numpy(np.int64), _matrix(sample["vec"])
    truth = exact_neighbours(rows, ids, q, k).select("query_id", "vec_id")
    near = truth.join(rows.select(F.col("id").alias("vec_id"), "vec"), "vec_id").toPandas()
    if not len(near):
        return 1
    place, goal = _places(q, model), np.floor(_places(_matrix(near["vec"]), model)).astype(np.int64)
    of = {int(i): j for j, i in enumerate(ids)}
    first = np.full(len(near), np.iinfo(np.int64).max)
    for t in range(len(place)):
        keys, rank = _keys(goal[t], t), {}
        for row, (query, key) in enumerate(zip(near["query_id"], keys)):
            if query not in rank:
                order = _keys(probe_order(place[t, of[int(query)]], MAX_PROBES), t)
                rank[query] = {int(b): i + 1 for i, b in reversed(list(enumerate(order)))}
            first[row] = min(first[row], rank[query].get(int(key), np.iinfo(np.int64).max))
    need = int(np.sort(first)[math.ceil(RECALL * len(first)) - 1])
    return need if need <= MAX_PROBES else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by Euclidean distance for each row of ``queries``, its own id left out.

    Every row is hashed into eight tables of p-stable hashes.  A query visits
    in each table the buckets most likely to hold its neighbours, and what
    the tables give is ranked by exact distances on the original vectors.
    The number of hashes follows the logarithm of the rows; slot width and
    number of probes are fitted on a bounded sample (2000 rows, 64 queries,
    whose true neighbours a scan of all rows finds) for a recall of 0.97 on
    it.  Buckets are searched in blocks of bounded numbers of rows and
    queries, so a bucket that holds a third of all rows is dealt to many
    tasks, and no pair becomes a row.  Queries left with fewer than ``k``
    neighbours, and all if no number of probes does, are scanned exactly, in
    blocks that meet in tasks.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to
    smaller ids.  A null id, a null, empty or zero vector, one with null or
    non-finite components, and one of another length than most take no
    part.  Of rows that repeat an id one vector is used.  Fewer than ``k``
    other rows: all of them; none, or an empty table: no rows.  Other columns
    are not used.
    """
    spark = vectors.sparkSession
    arrow_rows(spark, ARROW_ROWS)
    v = saved(usable(vectors, id_col, vector_col), "vectors")
    size = v.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = size["n"]
    v = v.where(F.size("vec") == size["dim"])
    q = saved(usable(queries, id_col, vector_col).where(F.size("vec") == size["dim"]), "queries")
    sample = _matrix(v.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).toPandas()["vec"])
    model = fit_hashes(sample, n)
    some = q.orderBy(F.xxhash64("id")).limit(SAMPLE_QUERIES).toPandas()
    probes = _probe_count(v, some, model, k) if len(some) else 1
    out = None
    if probes is not None:
        out = saved(_top(_probed(v, q, model, probes, k), k), "found")
        have = out.groupBy("query_id").agg(F.count("*").alias("m"))
        q = saved(q.join(have, F.col("id") == F.col("query_id"), "left")
                  .where(F.coalesce("m", F.lit(0)) < min(k, n)).select("id", "vec"), "short")
    # rows left by probing count too: a scan of the same query finds them again
    left = q.count()
    if left:
        more = saved(_scanned(v, q, left, n, k), "scanned")
        out = more if out is None else out.unionByName(more)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _top(out.select("query_id", "vec_id", "score"), k).select("query_id", "rank", "vec_id", "score")


def _scanned(v: DataFrame, q: DataFrame, queries: int, rows: int, k: int) -> DataFrame:
    """The ``k`` nearest of all rows for each of ``q``: one block of queries goes to the rows, more meet blocks of rows in tasks."""
    if queries <= EXACT_QUERIES:
        block = q.toPandas()
        return exact_neighbours(v, block["id"].to_numpy(np.int64), _matrix(block["vec"]), k)
    blocks = {"rb": math.ceil(rows / BLOCK_ROWS), "qb": math.ceil(queries / BLOCK_QUERIES)}

    def dealt(df: DataFrame, kind: int, own: str, other: str) -> DataFrame:
        return df.select(F.lit(0).cast("long").alias("bucket"), F.lit(kind).alias("kind"), "id", "vec",
                         F.pmod(F.xxhash64("id"), F.lit(blocks[own])).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks[other] - 1))).alias(other))

    return _top(_meet(dealt(v, 1, "rb", "qb"), dealt(q, 0, "qb", "rb"), k), k)


def _meet(rows: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """What the queries of a block find among its rows; blocks are (bucket, rb, qb)."""
    mixed_rows = rows.unionByName(asks).repartition("bucket", "rb", "qb")
    return (mixed_rows.sortWithinPartitions("bucket", "rb", "qb", "kind")
            .select("bucket", "rb", "qb", "kind", "id", "vec").mapInPandas(_search(k), RESULT))


def _probed(v: DataFrame, q: DataFrame, model: dict, probes: int, k: int) -> DataFrame:
    spark = v.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = dict(v.dtypes)["vec"]
    index = v.mapInPandas(_index(shared), f"bucket long, id long, vec {kind}")
    probe = saved(q.mapInPandas(_probes(shared, probes), f"bucket long, id long, vec {kind}"), "probes")
    # how many rows and queries meet in a bucket; buckets with only one kind are left out
    both = (index.select("bucket", F.lit(1).alias("r"), F.lit(0).alias("p"))
            .unionByName(probe.select("bucket", F.lit(0).alias("r"), F.lit(1).alias("p")))
            .groupBy("bucket").agg(F.sum("r").alias("r"), F.sum("p").alias("p")).where("r > 0 AND p > 0")
            .select("bucket", F.ceil(F.col("r") / BLOCK_ROWS).cast("int").alias("rbs"),
                    F.ceil(F.col("p") / BLOCK_QUERIES).cast("int").alias("qbs")))
    both = saved(both, "buckets")
    deal = lambda n: F.pmod(F.xxhash64("id", "bucket"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = (index.join(both, "bucket").select("bucket", deal("rbs").alias("rb"), F.lit(1).alias("kind"), "id", "vec",
                                              every("qbs").alias("qb")))
    asks = (probe.join(both, "bucket").select("bucket", F.lit(0).alias("kind"), "id", "vec", deal("qbs").alias("qb"),
                                              every("rbs").alias("rb")))
    return _meet(rows, asks, k)
