"""Token counts from flat files of token ids, by a scan for the separator.

A token file is nothing but ids of one width, each document closed by the separator id; there is
no index. Files are cut into blocks that tasks read and search on their own, vectorised. A
document may begin blocks before the separator that closes it: a prefix scan over the blocks of
a file hands each block the place after the last separator before it and how many came before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut
from .packing import encoder

#: Tokens of a block.
BLOCK = 1 << 20


def end_of(definition: str) -> int:
    """The id of the tokenizer's end-of-document token."""
    return json.loads(definition)["added_tokens"][0]["id"]


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_tokens(docs: DataFrame, definition: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every document's ids and the separator to flat files in ``folder``, one per task.

    Returns ``(file, ordinal, doc_id)``, computed once. Ids are little-endian unsigned 16-bit
    where the vocabulary allows it, else 32-bit. Special tokens' strings count as text, so the
    separator closes documents only. A null or empty text is a separator alone. A file appears
    under its name when it is whole; a task that runs again writes the same file again.
    """
    end = end_of(definition)
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = width(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encode, name = encoder(shared.value, ordinary=True), f"tokens-{context.partitionId():06d}.bin"
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        draft, ordinal = f"{root}/.{name}.{context.taskAttemptId()}", 0
        with system.open_output_stream(draft) as out:
            for batch in batches:
                for text in batch.column(1):
                    out.write(np.append(encode(text.as_py() or ""), np.uint32(end)).astype(kind).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
                ordinal += n
        if ordinal:
            system.move(draft, f"{root}/{name}")
        else:
            system.delete_file(draft)

    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return cut(only.mapInArrow(write, "file string, ordinal long, doc_id long"))


def width(definition: str) -> str:
    said = json.loads(definition)
    most = max([*said["model"]["vocab"].values(), *(t["id"] for t in said["added_tokens"])])
    return "<u2" if most < 1 << 16 else "<u4"


def count_tokens(spark: SparkSession, folder: str, end: int, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """``(file, ordinal, start, n_tokens, closed)`` for every document of the token files in ``folder``.

    ``start`` is the place of the document's first token in its file, ``n_tokens`` leaves the
    separator out. Tokens after the last separator of a file are a document that is not closed.
    Empty files have no documents; a file whose size is no multiple of the width is an error.
    """
    size = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    files = files.where("length > 0").select("path", F.when(F.col("length") % size == 0, F.expr(f"length div {size}")).otherwise(F.raise_error(F.concat(F.lit("cut-off token file: "), "path"))).alias("tokens"))
    blocks = files.select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block}"))).alias("block"))
    blocks = blocks.repartition(F.col("path"), F.col("block"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _open(row["path"])
                first = row["block"] * block
                with system.open_input_file(path) as file:
                    file.seek(first * size)
                    ids = np.frombuffer(file.read(min(block, row["tokens"] - first) * size), dtype=kind)
                ends = first + np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]]), "tokens": pa.array([row["tokens"]], pa.int64()), "block": pa.array([row["block"]], pa.int64()), "ends": pa.array([ends], pa.list_(pa.int64()))})

    found = cut(blocks.mapInArrow(search, "path string, tokens long, block long, ends array<long>"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = found.select("path", "block", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1).alias("after"))
    scanned = narrow.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("count"), F.coalesce(F.max("after").over(before), F.lit(0)).alias("begin"))
    name = F.regexp_extract("path", "[^/]+$", 0).alias("file")
    each = found.join(scanned, ["path", "block"])
    start = F.when(F.col("at") == 0, F.col("begin")).otherwise(F.try_element_at("ends", F.col("at")) + 1)
    closed = each.select("*", F.posexplode("ends").alias("at", "end")).select(name, (F.col("count") + F.col("at")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    totals = narrow.groupBy("path").agg(F.sum("n").alias("ordinal"), F.coalesce(F.max("after"), F.lit(0)).alias("start")).join(files, "path")
    rest = totals.where("start < tokens").select(name, "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)


def document_tokens(counted: DataFrame, written: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, file, ordinal, start)`` by joining counts to the order of writing."""
    return written.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
