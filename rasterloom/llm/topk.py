"""Exact top-k inner products through a pivot-distance index.

Maximum inner product is nearest neighbour after one coordinate is added that lifts every vector
to the same length. Lifted vectors are keyed by their nearest pivot and their distance to it; an
annulus is a range of distances around one pivot. Queries first search the annuli nearest to
them, which gives each a k-th best score; by the triangle inequality the distance between a
query and an annulus bounds the scores in it, and only annuli that can still hold as good a
score are searched in the second expansion. Bounds decide what is read, never what is returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut
from .vectors import TILE, batches_of, matrix, sample, split_column, tiles, unpack, usable

SCALE = 256
K = 5
PIVOTS = 32
#: Annuli in all, at most: their bounds are known to the driver.
MOST_RINGS = 4096
#: Queries searched together; rows that the first expansion reaches at least.
QUERIES = 512
FIRST_ROWS = 2 * TILE
_ROUNDS = 8
#: Squared lengths from here on have scores that no long holds.
MOST_LIFT = 2.0**63


class Index(NamedTuple):
    pivots: np.ndarray  # lifted: last coordinate is the lift
    lift: float  # squared length that every vector is lifted to
    cuts: list[np.ndarray]  # distances that part the annuli of each pivot
    first: np.ndarray  # number of each pivot's first annulus


class Rings(NamedTuple):
    ring: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray


def scaled(column: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double; kept as doubles."""
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T), 0.0))


def _lifted(x: np.ndarray, lift: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(lift - (x**2).sum(axis=1), 0.0))[:, None]))


def fit(x: np.ndarray, lift: float, rows: int, pivots: int = PIVOTS) -> Index:
    """Pivots by k-means from spread-out starts, and annuli of about a tile each, on a sample."""
    x = _lifted(x, lift)
    chosen = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(chosen) < min(pivots, len(x)) and near.max() > 0:
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, _distances(x, x[chosen[-1:]])[:, 0])
    centres = x[chosen]
    for _ in range(_ROUNDS):
        own = np.argmin(_distances(x, centres), axis=1)
        centres = np.stack([x[own == p].mean(axis=0) if (own == p).any() else centres[p] for p in range(len(centres))])
    own, far = np.argmin(_distances(x, centres), axis=1), _distances(x, centres).min(axis=1)
    cuts = []
    for p in range(len(centres)):
        held = np.sort(far[own == p])
        n = max(1, min(round(len(held) / len(x) * rows / TILE), MOST_RINGS // len(centres), len(held)))
        cuts.append(np.unique(held[(np.arange(1, n) * len(held)) // n]) if n > 1 else np.zeros(0))
    sizes = [len(c) + 1 for c in cuts]
    return Index(centres, lift, cuts, np.cumsum([0, *sizes[:-1]]))


def place(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot, distance to it and annulus of every vector."""
    distances = _distances(_lifted(x, index.lift), index.pivots)
    pivot = np.argmin(distances, axis=1)
    far = distances[np.arange(len(x)), pivot]
    ring = np.zeros(len(x), dtype=np.int64)
    for p in np.unique(pivot):
        ring[pivot == p] = index.first[p] + np.searchsorted(index.cuts[p], far[pivot == p], side="right")
    return pivot, far, ring


def bounds(queries: np.ndarray, index: Index, rings: Rings) -> np.ndarray:
    """Upper bound of the score of each query with any vector of each annulus."""
    at = np.hstack((queries, np.zeros((len(queries), 1))))
    far = _distances(at, index.pivots)[:, rings.pivot]
    gap = np.maximum(0.0, np.maximum(far - rings.most, rings.least - far))
    gap = np.maximum(0.0, gap * (1 - 1e-9) - 1e-6 * (1 + np.sqrt(index.lift)))
    both = (queries**2).sum(axis=1)[:, None] + index.lift
    return (both - gap**2) / 2 + 1.0 + 1e-12 * both


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> tuple[np.ndarray, float | int]:
    """Inner products of all rows, in doubles where these are exact, else in long; and what is below all of them."""
    if exact:
        return a @ b.T, -np.inf
    return a.astype(np.int64) @ b.astype(np.int64).T, np.iinfo(np.int64).min


def best(scores: np.ndarray, ids: np.ndarray, k: int, none: float | int = -np.inf) -> np.ndarray:
    """Positions of the k highest scores above ``none``, ties to the smaller id; fewer if there are fewer."""
    held = np.flatnonzero(scores > none)
    if len(held) > k:
        held = held[scores[held] >= np.partition(scores[held], len(held) - k)[len(held) - k]]
    return held[np.lexsort((ids[held], -scores[held]))][:k]


def gathered(pivots: np.ndarray, counts: dict[int, int], size: int = QUERIES) -> dict[int, int]:
    """Pivots put together until their queries fill a pack: each next one is the nearest to the last."""
    left, groups, held, group = sorted(counts), {}, 0, 0
    last = left[0] if left else 0
    while left:
        last = min(left, key=lambda p: (float(((pivots[p] - pivots[last]) ** 2).sum()), p))
        left.remove(last)
        if held and held + counts[last] > size:
            held, group = 0, group + 1
        groups[last], held = group, held + counts[last]
    return groups


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best scores of every query row, all if fewer.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another
    id. The score is the inner product of the components' floor(256 x). Vectors that are null,
    empty or hold a null or non-finite component take no part; vectors of different lengths are
    not compared. A null id takes no part. A query id that repeats is one query for each
    distinct vector, answered as one list; ties go to the smaller id. Scores are exact: where the
    largest squared length is too large for doubles, products are summed in integers, and where
    it is too large for a long, the query fails. Extra columns are ignored; an empty table gives
    an empty table.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull() & usable("vector"))
    good = cut(plain.select("id", scaled("vector").alias("vector")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    found = good.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("lift")).collect()
    parts = [_search(good.where(F.size("vector") == r["dim"]), r["dim"], r["n"], r["lift"], every, k) for r in sorted(found, key=lambda r: r["dim"])]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.union(more)
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(good: DataFrame, dim: int, n: int, lift: float, every: int, k: int) -> DataFrame:
    """Hits ``(query_id, vec_id, score)`` among vectors of one length that hold each query's k best."""
    if lift >= MOST_LIFT:
        raise ValueError(f"inner products of vectors of squared length {lift:g} are past a long")
    spark, exact = good.sparkSession, lift < 2.0**53  # no sum of products is larger than the largest squared length
    index = fit(sample(good, "vector", dim), lift, n)
    shared = spark.sparkContext.broadcast(tuple(index))  # plain, for workers without this package

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, far, ring = place(matrix(batch.column("vector"), dim), Index(*shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(ring, pa.int64()), pa.array(pivot, pa.int64()), pa.array(far), batch.column("id"), batch.column("vector")], names=["ring", "pivot", "far", "id", "vector"])

    dealt = cut(good.mapInArrow(deal, "ring long, pivot long, far double, id long, vector array<double>"))
    known = dealt.groupBy("ring", "pivot").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.count("*").alias("n")).orderBy("ring").toPandas()
    rings = Rings(*(known[c].to_numpy() for c in ("ring", "pivot", "least", "most", "n")))
    built = cut(tiles(dealt.withColumn("part", split_column(dict(zip(known["ring"].tolist(), known["n"].tolist())), "ring")), ["ring", "part"]))
    asked = dealt.where(F.col("id") % every == 0)
    per_pivot = {r["pivot"]: r["n"] for r in asked.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    near_pivots = gathered(index.pivots, per_pivot)
    group = F.element_at(F.create_map(*(F.lit(x) for p, g in near_pivots.items() for x in (p, g))), F.col("pivot")) if near_pivots else F.lit(0)
    sizes: dict[int, int] = {}
    for p, g in near_pivots.items():
        sizes[g] = sizes.get(g, 0) + per_pivot[p]
    asked = asked.withColumn("group", group.cast("long"))
    packs = tiles(asked.withColumn("pack", split_column(sizes, "group", QUERIES)), ["group", "pack"])
    packs = cut(packs.withColumn("pack", F.shiftleft("group", 32) + F.col("pack")).drop("group"))
    known_rings = spark.sparkContext.broadcast(tuple(rings))

    def nearest(body: np.ndarray) -> np.ndarray:
        """Annuli for the first expansion: the most promising ones with enough rows."""
        held = Rings(*known_rings.value)
        order = np.argsort(-bounds(body, Index(*shared.value), held).mean(axis=0), kind="stable")
        return order[: int(np.searchsorted(np.cumsum(held.rows[order]), FIRST_ROWS)) + 1]

    def expand_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batches_of(batches):
            chosen = Rings(*known_rings.value).ring[nearest(unpack(row["body"], dim, row["kind"]))]
            yield pa.RecordBatch.from_arrays([pa.array([row["pack"]] * len(chosen), pa.int64()), pa.array(chosen, pa.int64())], names=["pack", "ring"])

    def expand_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batches_of(batches):
            body, held = unpack(row["body"], dim, row["kind"]), Rings(*known_rings.value)
            least = {r["query_id"]: r["score"] for r in row["least"] or []}
            limit = np.array([least.get(i, -np.inf) for i in row["ids"]])
            open_rings = (bounds(body, Index(*shared.value), held) >= limit[:, None]).any(axis=0)
            open_rings[nearest(body)] = False
            chosen = held.ring[open_rings]
            yield pa.RecordBatch.from_arrays([pa.array([row["pack"]] * len(chosen), pa.int64()), pa.array(chosen, pa.int64())], names=["pack", "ring"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batches_of(batches):
            asked_ids, ids = np.array(row["asked"]), np.array(row["ids"])
            scores, none = products(unpack(row["asked_body"], dim, row["asked_kind"]), unpack(row["body"], dim, row["kind"]), exact)
            scores[asked_ids[:, None] == ids[None, :]] = none
            hits = [best(line, ids, k, none) for line in scores]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked_ids, [len(h) for h in hits])), pa.array(ids[np.concatenate(hits)]), pa.array(np.concatenate([line[h] for line, h in zip(scores, hits)]).astype(np.int64))],
                names=["query_id", "vec_id", "score"],
            )

    def searched(tasks: DataFrame) -> DataFrame:
        load = packs.select("pack", F.col("ids").alias("asked"), F.col("kind").alias("asked_kind"), F.col("body").alias("asked_body"))
        work = tasks.join(built.select("ring", "part", "ids", "kind", "body"), "ring").join(load, "pack").repartition("pack", "ring", "part")
        return work.select("asked", "asked_kind", "asked_body", "ids", "kind", "body").mapInArrow(score, "query_id long, vec_id long, score long")

    near = cut(_ranked(searched(packs.mapInArrow(expand_first, "pack long, ring long")), k).drop("rank"))
    ranked = near.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    members = packs.select("pack", F.explode("ids").alias("query_id"))
    least = members.join(ranked.where(F.col("at") == k).select("query_id", F.col("score").cast("double").alias("score")), "query_id")
    per_pack = least.groupBy("pack").agg(F.collect_list(F.struct("query_id", "score")).alias("least"))
    rest = packs.join(per_pack, "pack", "left").select("pack", "ids", "kind", "body", "least").mapInArrow(expand_rest, "pack long, ring long")
    return near.union(searched(rest))


#: DuckDB SQL for top_k() over embeddings.
SQL = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)) AS q FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""
