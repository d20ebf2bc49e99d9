"""Embedding near-duplicates: subspace pigeonhole join on rotated vectors, exact verification.

Unit vectors are rotated (a rotation keeps distances) and their coordinates split into blocks.
Each block gets a share of the squared distance that the cosine limit allows, in proportion to
the block's variance; the shares add up to the whole, so a pair within the limit is within the
share of at least one block. A tree over the rotated coordinates deals the vectors out to
leaves; pairs of leaves that are too far apart in every block are left out, the other pairs are
range-joined block by block under the shares, and the union of candidates is verified exactly.
Links are never listed: each pair of tiles returns counts and one tie per linked vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut
from .vectors import batches_of, matrix, sample, split_column, tiles, unpack, usable

LEAST_COSINE = 0.9
BLOCKS = 4
#: Components, and rows, of a tile; each pair of tiles travels to a task of its own, so larger ones travel less.
TILE_SIZE, TILE_LEAST, TILE_MOST = 1 << 19, 512, 8192
#: Leaves of the tree, at most: they and their pairs are known to the driver.
MOST_LEAVES = 1024
#: A component of more than one in so many linked rows is joined by broadcast.
HOT_SHARE = 1000
#: Rows of one tile compared at a time; single-precision error that a block's share is widened by.
STRIP = 512
SLACK = 1e-5


class Subspaces(NamedTuple):
    """Rotation, blocks with their shares, and a tree over the rotated coordinates of one length of vectors."""

    first: int  # number of the first leaf
    rotation: np.ndarray
    edges: list[int]
    shares: np.ndarray
    axis: np.ndarray  # split coordinate of each inner node, heap order
    at: np.ndarray
    low: np.ndarray  # bounds of each leaf's region
    high: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.low)


def tile_rows(dim: int) -> int:
    return max(TILE_LEAST, min(TILE_MOST, TILE_SIZE // dim))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first scaled by their largest component, whose square may be beyond doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, first: int, rows: int, limit: float, blocks: int = BLOCKS) -> Subspaces:
    """Rotate to principal axes, share the budget by variance, split the widest axis at its median."""
    dim = x.shape[1]
    spread, axes = np.linalg.eigh(np.cov(x.T).reshape(dim, dim)) if len(x) > 1 else (np.ones(dim), np.eye(dim))
    rotation = axes[:, ::-1]
    spread = np.maximum(spread[::-1], 1e-12)
    edges = np.linspace(0, dim, min(blocks, dim) + 1).astype(int).tolist()
    weight = np.array([spread[a:b].sum() for a, b in zip(edges, edges[1:])])
    depth = max(0, min(int(np.ceil(np.log2(max(1, rows) / tile_rows(dim)))), int(np.log2(MOST_LEAVES)), int(np.log2(max(1, len(x) // 8)))))
    y, node = x @ rotation, np.zeros(len(x), dtype=np.int64)
    axis, at = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    low, high = np.full((2 << depth, dim), -np.inf), np.full((2 << depth, dim), np.inf)
    for i in range((1 << depth) - 1):
        own = y[node == i]
        axis[i] = int(np.argmax(own.std(axis=0))) if len(own) else 0
        at[i] = float(np.median(own[:, axis[i]])) if len(own) else 0.0
        node[node == i] = 2 * i + 1 + (own[:, axis[i]] >= at[i])
        for child in (2 * i + 1, 2 * i + 2):
            low[child], high[child] = low[i], high[i]
        high[2 * i + 1][axis[i]] = low[2 * i + 2][axis[i]] = at[i]
    last = (1 << depth) - 1
    return Subspaces(first, rotation, edges, limit * weight / weight.sum(), axis, at, low[last : last + (1 << depth)], high[last : last + (1 << depth)])


def leaf_of(y: np.ndarray, space: Subspaces) -> np.ndarray:
    node = np.zeros(len(y), dtype=np.int64)
    for _ in range(space.leaves.bit_length() - 1):
        node = 2 * node + 1 + (y[np.arange(len(y)), space.axis[node]] >= space.at[node])
    return space.first + node - (space.leaves - 1)


def leaf_pairs(space: Subspaces) -> list[tuple[int, int, int]]:
    """Pairs of leaves ``(i, j, blocks)``, i <= j, with the blocks (as bits) under whose share they can hold a link."""
    found = []
    for i in range(space.leaves):
        gap = np.maximum(0.0, np.maximum(space.low[i] - space.high[i:], space.low[i:] - space.high[i])) ** 2
        near = np.stack([gap[:, a:b].sum(axis=1) <= s + SLACK for a, b, s in zip(space.edges, space.edges[1:], space.shares)])
        bits = (near * (1 << np.arange(len(space.shares)))[:, None]).sum(axis=0)
        found += [(space.first + i, space.first + i + int(j), int(bits[j])) for j in np.flatnonzero(bits)]
    return found


def tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per node after joining nodes ``a`` and ``b`` pairwise."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _left(x: np.ndarray) -> np.ndarray:
    """Rows that, multiplied with :func:`_right`, give squared distances."""
    return np.hstack((-2 * x, (x**2).sum(axis=1)[:, None], np.ones((len(x), 1), dtype=x.dtype)))


def _right(y: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.hstack((y, np.ones((len(y), 1), dtype=y.dtype), (y**2).sum(axis=1)[:, None])).T)


def compare(x: np.ndarray, y: np.ndarray, same: bool, blocks: int, space: Subspaces, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of x, then of y, and for each the smallest row it is tied to through them."""
    n = len(x)
    rx, ry = (x @ space.rotation).astype(np.float32), (y @ space.rotation).astype(np.float32)
    parts = [(a, b, np.float32(s + SLACK)) for k, (a, b, s) in enumerate(zip(space.edges, space.edges[1:], space.shares)) if blocks >> k & 1]
    sides = [(_left(rx[:, a:b]), _right(ry[:, a:b]), s) for a, b, s in parts]
    links, root = np.zeros(n + len(y), dtype=np.int64), np.arange(n + len(y))
    if same:
        root[n:] = np.arange(len(y))
    for at in range(0, n, STRIP):
        near = np.zeros((min(STRIP, n - at), len(y)), dtype=bool)
        for own, other, share in sides:
            near |= own[at : at + STRIP] @ other <= share
        if same:
            near &= np.arange(at, at + len(near))[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(near)
        fine = np.ones(len(i), dtype=bool)
        for k in range(0, len(i), 1 << 16):  # one formula for all pairs, in bounded memory
            some = slice(k, k + (1 << 16))
            fine[some] = np.einsum("ij,ij->i", x[i[some] + at], y[j[some]]) >= least
        i, j = i[fine], j[fine]
        if len(i):
            np.add.at(links, i + at, 1)
            np.add.at(links, j + (0 if same else n), 1)
            root = tie(root, i + at, j + (0 if same else n))
    return links, root


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST_COSINE, blocks: int = BLOCKS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Rows link at a cosine of ``least`` or more, in double precision. Vectors that are null,
    empty, zero or hold a null or non-finite component link with nothing, and vectors of
    different lengths do not link. Each row counts for itself, also where ids or vectors repeat.
    ``component_id`` is the smallest id reachable; null ids are passed over in it, and a null id
    is kept only where nothing else is reachable. Extra columns are ignored; an empty table gives
    an empty table.
    """
    spark = rows.sparkSession
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    able = usable("vector") & F.exists("vector", lambda x: x != 0)
    good = plain.where(able)
    spaces: dict[int, Subspaces] = {}
    first = 0
    for dim, n in sorted((r["dim"], r["n"]) for r in good.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()):
        spaces[dim] = fit(unit(sample(good, "vector", dim)), first, n, 2 - 2 * least, blocks)
        first += spaces[dim].leaves
    if not spaces:
        return _alone(plain)
    shared = spark.sparkContext.broadcast({dim: tuple(space) for dim, space in spaces.items()})  # plain, for workers without this package

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                space = Subspaces(*shared.value[dim])
                leaf = leaf_of(unit(matrix(own.column("vector"), dim)) @ space.rotation, space)
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), own.column("id"), own.column("vector")], names=["leaf", "id", "vector"])

    dealt = cut(good.mapInArrow(deal, "leaf long, id long, vector array<double>"))
    counts = {r["leaf"]: r["n"] for r in dealt.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    built = cut(tiles(dealt.withColumn("part", split_column(counts, "leaf", min(map(tile_rows, spaces)))), ["leaf", "part"]).withColumn("tile", F.shiftleft("leaf", 20) + F.col("part")))
    listed = [(i, j, b) if (i + j) % 2 == 0 else (j, i, b) for s in spaces.values() for i, j, b in leaf_pairs(s)]  # each leaf comes second in half of its pairs
    pairs = spark.createDataFrame(listed, "i long, j long, blocks long")
    a, b = (built.select(F.col("leaf").alias(leaf), F.col("tile").alias(f"t{leaf}")) for leaf in "ij")
    tasks = pairs.join(a, "i").join(b, "j").where("i <> j or ti <= tj").select("ti", "tj", "blocks")
    load = [built.select(F.col("tile").alias(f"t{k}"), F.col("dim"), F.col("kind").alias(f"kind_{k}"), F.col("body").alias(f"body_{k}")) for k in "ij"]
    work = tasks.join(load[0], "ti").join(load[1].drop("dim"), "tj")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in batches_of(batches):
            x, y = (unit(unpack(row[f"body_{k}"], row["dim"], row[f"kind_{k}"])) for k in "ij")
            same = row["ti"] == row["tj"]
            links, root = compare(x, y, same, row["blocks"], Subspaces(*shared.value[row["dim"]]), least)
            some = np.flatnonzero(links)
            if len(some):
                node = np.concatenate(((row["ti"] << 20) + np.arange(len(x)), (row["tj"] << 20) + np.arange(len(y))))
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["node", "links", "root"])

    found = cut(work.mapInArrow(verify, "node long, links long, root long"))
    nodes = built.select("tile", F.posexplode("ids").alias("pos", "id")).select((F.shiftleft("tile", 20) + F.col("pos")).alias("node"), "id")
    linked = nodes.join(found.groupBy("node").agg(F.sum("links").alias("n_links")), "node")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "top")
    rooted = cut(linked.join(roots, "node").select("id", "n_links", "top"))
    least_id = cut(rooted.groupBy("top").agg(F.min("id").alias("component_id"), F.count("*").alias("n")))
    many = least_id.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE >= many  # so there are HOT_SHARE of them at most, and none of the others is large
    named = rooted.join(F.broadcast(least_id.where(hot).drop("n")), "top").union(_cold(rooted, least_id, hot))
    free = nodes.join(found.select("node").distinct(), "node", "left_anti").select("id")
    joined = named.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return joined.union(_alone(free)).union(_alone(plain.where(~able)))


def _cold(rooted: DataFrame, least_id: DataFrame, hot: Column) -> DataFrame:
    """``rooted`` with the least id of its component, for the components that are not hot."""
    left = rooted.join(F.broadcast(least_id.where(hot).select("top")), "top", "left_anti")
    return left.join(least_id.where(~hot).drop("n"), "top")


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))


#: DuckDB SQL for near_duplicates() over embeddings whose ids are unique.
SQL = f"""WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {LEAST_COSINE}),
r(id, top) AS (SELECT a, a FROM l UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(top) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.id = vec_id"""
