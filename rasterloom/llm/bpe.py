"""Byte-level BPE over a distinct-word table, and decoding through an id-to-piece join.

Words are cut at single spaces between non-space characters, a place where the tokenizer's own
pattern always cuts, whatever stands around. Each task turns its documents into positions in a
dictionary of its distinct words; the dictionaries are dealt out by a hash of the word, where
each distinct word of the corpus is encoded once; the ids come back in dictionary order and are
joined to the positions.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import give_back

#: Characters of text whose words share one dictionary.
CHUNK = 4_000_000
#: Input bytes for each part that dictionaries are dealt out in, and the least number of parts.
PART_BYTES, LEAST_PARTS = 4_000_000, 32
#: Beyond so many parts a dictionary's share is a few words only, so parts grow to this size before their number does.
MANY_PARTS, WIDE_PART_BYTES = 4096, 256_000_000
#: Documents whose positions travel in one row.
ROW_DOCS = 512
#: A space next to white space, as any Unicode version has it, or at an end: no place to cut.
_UNSAFE = re.compile(r"^ | $|[\s\u180e] | [\s\u180e]")
_SAFE_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")


def vocabulary(path: str) -> str:
    """The tokenizer's definition, read on the driver; its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _words(text: str) -> tuple[str, list[str]]:
    """The first word and the further ones without the space that each leads with."""
    parts = _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
    return parts[0], parts[1:]


def pieces_of(definition: str) -> list[bytes]:
    """The bytes that each id stands for, by id."""
    said = json.loads(definition)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
    ids = said["model"]["vocab"] | {t["content"]: t["id"] for t in said["added_tokens"]}
    table = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return table


def _squeeze(numbers: np.ndarray) -> bytes:
    """Compressed byte by byte place: the high bytes of small numbers take next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return zstandard.ZstdCompressor(level=3).compress(len(words).to_bytes(4, "little") + lengths.tobytes() + b"".join(words))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = 4 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw[4 : 4 + 4 * n], dtype="<u4"), dtype=np.int64)))
    ends = ends.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


class _Chunk:
    """Documents of a task that share a dictionary of words.

    A word that leads with a space is held without it, the one that opens a document after
    NUL F; a further word that itself begins with NUL is held after NUL R.
    """

    def __init__(self) -> None:
        self.ids: list = []
        self.index: dict[str, int] = {}
        self.positions: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        self.size += len(text or "")
        if not text:
            self.positions.append(np.zeros(0, dtype="<u4"))
            return
        first, rest = _words(text)
        index, out = self.index, array("I")
        out.append(index.setdefault("\0F" + first, len(index)))
        if "\0" in text:
            rest = ["\0R" + w if w.startswith("\0") else w for w in rest]
        out.extend([index.setdefault(w, len(index)) for w in rest])
        self.positions.append(np.frombuffer(out, dtype="<u4"))

    def parts(self, n: int) -> tuple[list[list[bytes]], np.ndarray]:
        """The words of each of n parts, and of each word its place when the parts follow each other."""
        words = [w.encode("utf-8", "surrogatepass") for w in self.index]
        part = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words)) % n
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=n)).tolist()
        listed = [words[i] for i in order.tolist()]
        place = np.empty(len(words), dtype="<u4")
        place[order] = np.arange(len(words), dtype="<u4")
        return [listed[a:b] for a, b in zip([0, *ends], ends)], place

    def key(self) -> int:
        """Names the content in its order: a task that is run again on other rows gets another key."""
        mark = hashlib.blake2b(digest_size=8)
        mark.update(f"{self.ids[0]} {self.ids[-1]} {len(self.ids)} {self.size}".encode())
        mark.update("\0".join(self.index).encode("utf-8", "surrogatepass"))
        return int.from_bytes(mark.digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            chunk.add(doc_id.as_py(), text.as_py())
            if chunk.size >= CHUNK:
                yield chunk
                chunk = _Chunk()
                give_back()
    if chunk.ids:
        yield chunk
    del chunk
    give_back()


def _dictionaries(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            key, (parts, _) = chunk.key(), chunk.parts(n)
            for p, words in enumerate(parts):
                if words:
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([key], pa.int64()), "part": pa.array([p], pa.int32()), "words": pa.array([_pack(words)], pa.binary())})

    return emit


def _positions(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of a chunk, some hundred a row, as positions in its dictionary."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            key, (parts, place) = chunk.key(), chunk.parts(n)
            for at in range(0, len(chunk.ids), ROW_DOCS):
                held = chunk.positions[at : at + ROW_DOCS]
                yield _row(key, -1, _squeeze(place[np.concatenate(held)]), sum(map(bool, parts)), chunk.ids[at : at + ROW_DOCS], list(map(len, held)))

    return emit


_ROW = "chunk long, part int, body binary, filled int, doc_ids array<long>, lengths array<int>"


def _row(chunk: int, part: int, body: bytes, filled: int = 0, doc_ids: list | None = None, lengths: list[int] | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "chunk": pa.array([chunk], pa.int64()),
            "part": pa.array([part], pa.int32()),
            "body": pa.array([body], pa.binary()),
            "filled": pa.array([filled], pa.int32()),
            "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int32())),
        }
    )


def word_ids(dictionaries: DataFrame, definition: str) -> DataFrame:
    """Rows with the ids of each dictionary's words in their order, by chunk and part.

    All dictionaries' shares of a part meet in one group, where each distinct word is encoded once.
    """
    shared = dictionaries.sparkSession.sparkContext.broadcast(definition)

    def encode(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread keeps memory
        tokenizer = Tokenizer.from_str(shared.value)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in group:
            for chunk, part, blob in zip(batch.column("chunk"), batch.column("part"), batch.column("words")):
                words = _unpack(blob.as_py())
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 4096):
                    some = new[at : at + 4096]
                    for w, e in zip(some, tokenizer.encode_batch_fast([_surface(w) for w in some], add_special_tokens=False)):
                        known[w] = tuple(e.ids)
                ids = [known[w] for w in words]
                counts = np.fromiter(map(len, ids), dtype="<u4", count=len(ids))
                flat = np.fromiter((i for x in ids for i in x), dtype="<u4", count=int(counts.sum()))
                yield _row(chunk.as_py(), part.as_py(), _squeeze(np.concatenate((np.array([len(ids)], dtype="<u4"), counts, flat))))
        known.clear()
        give_back()

    return dictionaries.groupBy("part").applyInArrow(encode, _ROW)


def _surface(word: bytes) -> str:
    """The text of a dictionary's word."""
    said = word.decode("utf-8", "surrogatepass")
    if said.startswith("\0"):
        return said[2:] if said[1] == "F" else " " + said[2:]
    return " " + said


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _join(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the ids of a chunk's words to the positions of its documents."""
    held: list[tuple] = []
    bodies: dict[int, np.ndarray] = {}
    for batch in group:
        for row in batch.to_pylist():
            if row["part"] >= 0:
                bodies[row["part"]] = _numbers(row["body"])
            else:
                held.append((row["filled"], row["doc_ids"], np.array(row["lengths"], dtype=np.int64), row["body"]))
    if any(filled != len(bodies) for filled, *_ in held):
        raise RuntimeError("a chunk of documents was read twice with different rows")
    order = [bodies.pop(p) for p in sorted(bodies)]
    counts = np.concatenate([b[1 : 1 + b[0]] for b in order]).astype(np.int64) if order else np.zeros(0, dtype=np.int64)
    flat = np.concatenate([b[1 + b[0] :] for b in order]) if order else np.zeros(0, dtype="<u4")
    starts = np.cumsum(counts) - counts
    for _, doc_ids, lengths, body in held:
        at, edges = _numbers(body), np.concatenate(([0], np.cumsum(lengths)))
        for k in range(0, len(doc_ids), 64):  # bounds a batch; one document's ids are as long as they are
            some = range(k, min(k + 64, len(doc_ids)))
            ids = [_gather(flat, starts[p], counts[p]).astype("<u4").tobytes() for p in (at[edges[i] : edges[i + 1]] for i in some)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_ids[i] for i in some], pa.int64()), "ids": pa.array(ids, pa.binary())})


def encode(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the whole text's token ids, little-endian unsigned 32-bit, one row per row.

    The ids are those of the tokenizers library with ``add_special_tokens=False`` and neither
    truncation nor padding. A null or empty text has none. Null and repeated ids are carried,
    extra columns ignored; an empty table gives an empty table. The input is read twice, so its
    partitions must come out the same each time, as those of files do; where they do not, the
    join fails and names this.
    """
    return _joined(docs, definition, id_col, text_col).applyInArrow(_join, "doc_id long, ids binary")


def parts_for(size: int) -> int:
    """Parts for so many bytes of input: their number has no ceiling, and a part stands for 256 MB of input at most."""
    return max(LEAST_PARTS, min(MANY_PARTS, size // PART_BYTES), -(-size // WIDE_PART_BYTES))


def _joined(docs: DataFrame, definition: str, id_col: str, text_col: str) -> GroupedData:
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = int(str(only._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > MANY_PARTS * PART_BYTES:  # a plan's estimate may be far too large, or unknown
        size = only.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0] or 0
    n = parts_for(size)
    dealt = only.mapInArrow(_dictionaries(n), "chunk long, part int, words binary").repartition(n, "part")  # by number: encoding is slow for its bytes, so partitions are not merged
    ids = word_ids(dealt, definition)
    return only.mapInArrow(_positions(n), _ROW).union(ids).groupBy("chunk")


def decode(encoded: DataFrame, definition: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` for rows ``(doc_id, ids)``: ids joined to their pieces, bytes read as UTF-8.

    The pieces are a table of one vocabulary, which bounds its broadcast. Bytes that are no UTF-8
    become U+FFFD. Null ids give null, no ids the empty text; an id without a piece gives nothing.
    """
    shared = _pieces(encoded.sparkSession, definition)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, *shared.value)

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, decoded)``: :func:`encode`, then :func:`decode`, one after the other in one worker."""
    shared = _pieces(docs.sparkSession, definition)

    def join(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _join(group):
            yield _decoded(batch, *shared.value)
        give_back()

    return _joined(docs, definition, id_col, text_col).applyInArrow(join, "doc_id long, ids binary, decoded string")


def _pieces(spark: SparkSession, definition: str) -> Broadcast:
    pieces = pieces_of(definition)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths))


def _decoded(batch: pa.RecordBatch, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    texts: list[str | None] = []
    for blob in batch.column("ids"):
        if blob.as_py() is None:
            texts.append(None)
            continue
        ids = np.frombuffer(blob.as_py(), dtype="<u4")
        ids = ids[ids < len(sizes)]
        texts.append(_gather(body, starts[ids], sizes[ids]).tobytes().decode("utf-8", "replace"))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])
