"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A 64-bit fingerprint is embedded as the bit counts of its two-bit segments (of one-bit segments
in very large tables). Manhattan distance between two such vectors never exceeds the Hamming
distance of the fingerprints, so pairs farther apart than the limit of 4 in the embedding are
ruled out without looking at bits. The vector is cut in two halves: of two fingerprints within
distance 4, one half is within Manhattan distance 2, so both reach a common grid cell by one unit
step each.
Fingerprints are joined on those cells and what is left is verified on all 64 bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, give_back, join_on_hot_key

MAX_DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Fingerprints from which on segments are one bit wide: cells of two-bit segments hold N / 6.5 million of N unrelated ones, of one bit N / 4 billion.
MANY = 1 << 24
#: Fingerprints in one unexpanded cell from which on pairs among them are found by midpoints.
DENSE = 64

_LOW = 0x55555555


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of one text; zero for a null text or one without words.

    bytes.lower() and bytes.split() act on A-Z and on the six ASCII white spaces only.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(line, seed)]
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        hashes = [digest(line[a : b - 1], seed) for a, b in zip(itertools.chain((0,), ends), ends[shingle - 1 :])]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])
    give_back()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; rows are neither merged nor dropped."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return only.mapInArrow(_fingerprints, "doc_id long, fp long")


def _unary(half: Column, width: int) -> Column:
    """Bit counts of the segments of a 32-bit half, each in unary (00, 01, 11 for two bits, 0, 1 for one).

    In unary the Manhattan distance of two vectors is the Hamming distance of their codes.
    """
    if width == 1:
        return half
    high, low = F.shiftright(half, 1).bitwiseAND(F.lit(_LOW)), half.bitwiseAND(F.lit(_LOW))
    return F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high.bitwiseOR(low))


def _halves(prints: DataFrame, width: int) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return prints.withColumn("c0", _unary(low, width)).withColumn("c1", _unary(high, width))


def _ball(code: Column, width: int) -> Column:
    """The cells within Manhattan distance 1 of a unary code, itself included."""

    def step(i: Column) -> Column:
        segment = F.expr("cast(3 as bigint)") * F.pow(F.lit(4.0), i).cast("long")
        one = F.pow(F.lit(4.0), i).cast("long")
        has = code.bitwiseAND(segment)
        return (
            F.when(has == 0, F.array(code.bitwiseOR(one)))
            .when(has == one, F.array(code.bitwiseXOR(one), code.bitwiseOR(segment)))
            .otherwise(F.array(code.bitwiseXOR(segment).bitwiseOR(one)))
        )

    if width == 1:
        return F.concat(F.array(code), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: code.bitwiseXOR(F.pow(F.lit(2.0), i).cast("long"))))
    return F.concat(F.array(code), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), step)))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def grid_links(prints: DataFrame, dense: int = DENSE, width: int = 2) -> DataFrame:
    """Links ``(a, b)`` that join all distinct ``prints(fp)`` within Hamming distance 4.

    Pairs are found through grid cells and verified exactly. Where an unexpanded cell holds
    ``dense`` fingerprints or more, pairs of two such crowded fingerprints are left to
    :func:`midpoint_links`, which is linear in their number and as exact, so no crowded cell
    is ever compared all against all. The links returned connect what lies within the limit;
    for crowded fingerprints they lead over a common neighbour instead of naming each pair.
    ``width`` is the bits of a segment, two or one; links are the same, cells are smaller with one.
    """
    both = _halves(prints, width)
    codes = both.select("fp", F.posexplode(F.array("c0", "c1")).alias("half", "code"), "c0")
    crowded = codes.groupBy("half", "code").agg(F.count("*").alias("n")).where(F.col("n") >= dense).select("half", "code", F.lit(True).alias("crowded"))
    marked = codes.join(crowded, ["half", "code"], "left").select("fp", "half", "code", "c0", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    marked = cut(marked)
    cells = marked.select("fp", "half", "code", "c0", "crowded", F.explode(_ball(F.col("code"), width)).alias("cell"))
    a = cells.select(*(F.col(c).alias(f"a_{c}") for c in cells.columns))
    b = cells.select(*(F.col(c).alias(f"b_{c}") for c in cells.columns))
    within = _apart("a_code", "b_code")
    once = (F.col("a_cell") == F.col("a_code")) | ((within == 2) & (F.col("a_cell") != F.col("b_code")))
    found = a.join(
        b,
        (F.col("a_half") == F.col("b_half"))
        & (F.col("a_cell") == F.col("b_cell"))
        & (F.col("a_fp") < F.col("b_fp"))
        & ~(F.col("a_crowded") & F.col("b_crowded"))
        & once
        & ((F.col("a_half") == 0) | (_apart("a_c0", "b_c0") > 2))
        & (_apart("a_fp", "b_fp") <= MAX_DISTANCE),
    ).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    heavy = marked.where("crowded").select("fp").distinct()
    return found.union(midpoint_links(heavy)).distinct()


def midpoint_links(prints: DataFrame) -> DataFrame:
    """Links that join ``prints(fp)`` within Hamming distance 4, linear in their number.

    Two fingerprints lie within distance 4 just if some 64-bit value lies within distance 2 of
    both. Each value within 2 that is shared links its fingerprints to the smallest of them.
    """
    flips = F.expr(
        "concat(array(cast(0 as bigint)), transform(sequence(0, 63), i -> shiftleft(cast(1 as bigint), i)), "
        "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(cast(1 as bigint), i) | shiftleft(cast(1 as bigint), j)))))"
    )
    mids = prints.withColumn("flip", F.explode(flips)).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    hubs = mids.groupBy("mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).where("hub < last").select("mid", "hub")
    return join_on_hot_key(mids, hubs, "mid").where("fp > hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    * Rows link if their fingerprints differ in 4 bits or fewer; ``component_id`` is the
      smallest ``doc_id`` reachable. Equal fingerprints are collapsed before the join.
    * A null or empty text has fingerprint zero and links like any other.
    * A null id is carried and never chosen as component id unless its component has no other.
    * Repeated ids and rows are kept as they are. An empty table gives an empty table.
    * Extra columns are ignored, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    width = 1 if prints.count() >= MANY else 2
    roots = components(grid_links(classes.select("fp"), width=width)).withColumnsRenamed({"node": "fp"})
    rooted = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = join_on_hot_key(rooted.select("fp", "root"), least, "root").select("fp", "component_id")
    return join_on_hot_key(prints, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the row whose id names the component.

    Rows that repeat both id and text are one. Rows with a null id are kept, as nothing names them.
    """
    gone = near_duplicates(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    return named.dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))
