"""Packing of documents into fixed windows by non-negative least squares.

A document is its token ids and a closing id. Whole windows of it stand alone; what remains is
counted in a histogram of lengths. All combinations of up to three lengths that fill a window
are enumerated, their repeat counts solved for against the histogram, rounded and dealt out.
What is left is packed greedily; windows that stay loose are joined, cut anew at the window's
length, and their last part is cut into sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import pieces_of
from .common import give_back

WINDOW = 1024
#: Lengths count in steps of so many tokens; the most parts of a combination.
STEP = 8
DEPTH = 3
#: Tokens whose documents are packed together; more free tokens than these make a window loose.
CHUNK = 8_000_000
LOOSE = 16
END_ID = 0

#: White space in a row that the faster library's pattern is given at most; it keeps a state for each character of a run.
_MOST_SPACE = 1 << 18
#: Characters whose class no Unicode version changes; texts with others go to the library itself.
_SETTLED = re.compile("[\x00-\x1b\x20-ɏ‐-‧‰-⁞€]*")
_SPACE = re.compile(r"\s+")
#: The pattern that byte-level tokenizers cut words by.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(definition: str, ordinary: bool = False) -> Callable[[str], np.ndarray]:
    """Encodes whole texts as the tokenizers library does with this byte-level BPE definition.

    ``ordinary``: special tokens' strings in a text are text like any other.

    The merges run in the faster of two libraries with one vocabulary; a text with a special
    token in it, with characters whose class depends on a Unicode version, or with a very long
    run of white space goes to the other.
    """
    said = json.loads(definition)
    special = {t["content"] for t in said["added_tokens"]}
    exact = Tokenizer.from_str(definition)
    exact.no_truncation()
    exact.no_padding()
    exact.encode_special_tokens = ordinary
    ranks = {piece: i for i, piece in enumerate(pieces_of(definition)) if piece and piece.decode("utf-8", "replace") not in special}
    fast = tiktoken.Encoding("packing", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype="<u4")
        spaced = len(text) > _MOST_SPACE and any(m.end() - m.start() > _MOST_SPACE for m in _SPACE.finditer(text))
        if not spaced and _SETTLED.fullmatch(text) and (ordinary or not any(s in text for s in special)):
            return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All multisets of up to ``depth`` lengths that fill ``units`` exactly, each in falling order."""

    def fill(left: int, most: int, parts: int) -> Iterator[tuple[int, ...]]:
        if left <= most:
            yield (left,)
        if parts > 1:
            for first in range(min(most, left - 1), (left - 1) // parts, -1):
                for rest in fill(left - first, first, parts - 1):
                    yield (first, *rest)

    return list(fill(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises |a x - b| (Lawson and Hanson, 1974), on the normal equations."""
    gram, right = a.T @ a, a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0.0)))
    for _ in range(3 * a.shape[1]):
        slope = np.where(passive, -np.inf, right - gram @ x)
        j = int(np.argmax(slope))
        if slope[j] <= tolerance:
            break
        passive[j] = True
        while passive.any():
            own = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(own, own)], right[own], rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            low = own[s <= 0]
            before = x[low] - s[s <= 0]
            ratio = float(np.min(np.divide(x[low], before, out=np.zeros(len(low)), where=before > 0)))
            x[own] += ratio * (s - x[own])
            passive[own[(x[own] <= 1e-12) | (s <= 0) & (x[own] <= 1e-9)]] = False
            x[~passive] = 0
    return x


def plan(lengths: list[int], window: int = WINDOW, step: int = STEP) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(item, start, length)`` that hold items of the given lengths whole.

    Every token of every item is in just one piece. A sequence is at most ``window`` long; all
    but those packed to within a few tokens are exactly full or of a power-of-two length.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    by_unit: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for item, n in enumerate(lengths):
        whole = n // window
        sequences += [[(item, k * window, window)] for k in range(whole)]
        if n % window:
            by_unit[-(-(n % window) // step)].append((item, whole * window, n % window))
    units = window // step
    shapes = combinations(units)
    matrix = np.zeros((units, len(shapes)))
    for j, shape in enumerate(shapes):
        for u in shape:
            matrix[u - 1, j] += 1
    counts = np.array([len(by_unit[u]) for u in range(1, units + 1)], dtype=float)
    wanted = nnls(matrix, counts) if counts.any() else np.zeros(len(shapes))
    for j in np.argsort(-wanted, kind="stable"):
        repeats = int(np.rint(wanted[j]))
        if not repeats:
            break
        for _ in range(min(repeats, *(len(by_unit[u]) // shapes[j].count(u) for u in set(shapes[j])))):
            sequences.append([by_unit[u].pop() for u in shapes[j]])
    rest = sorted((p for held in by_unit.values() for p in held), key=lambda p: (-p[2], p[0]))
    return sequences + _greedy(rest, window)


def _greedy(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Best fit, longest first; then loose windows are joined and cut anew."""
    bins: list[list[tuple[int, int, int]]] = []
    free: list[tuple[int, int]] = []
    for piece in pieces:
        at = bisect_left(free, (piece[2], -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(piece)
        else:
            room, b = window, len(bins)
            bins.append([piece])
        insort(free, (room - piece[2], b))
    tight = [bins[b] for room, b in free if room <= LOOSE]
    loose = [p for room, b in sorted(free) if room > LOOSE for p in bins[b]]
    return tight + _cut(loose, window)


def _cut(pieces: list[tuple[int, int, int]], window: int) -> list[list[tuple[int, int, int]]]:
    """The pieces in a row, cut into full windows and then into falling powers of two."""
    left = sum(p[2] for p in pieces)
    sequences: list[list[tuple[int, int, int]]] = []
    own: list[tuple[int, int, int]] = []
    room = min(window, 1 << (left.bit_length() - 1)) if left else 0
    for item, start, n in pieces:
        while n:
            take = min(n, room)
            own.append((item, start, take))
            start, n, room, left = start + take, n - take, room - take, left - take
            if not room:
                sequences.append(own)
                own = []
                room = min(window, 1 << (left.bit_length() - 1)) if left else 0
    return sequences


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _rows(ids: list, tokens: list[np.ndarray], first: int) -> Iterator[tuple]:
    for s, sequence in enumerate(plan([len(t) for t in tokens])):
        offset = 0
        for item, start, n in sequence:
            yield ids[item], start, n, tokens[item][start : start + n].tobytes(), len(tokens[item]), first + s, offset
            offset += n


def pack(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of all documents.

    ``ids`` are little-endian unsigned 32-bit. A sequence is padded to the window unless its
    length is a power of two. A null or empty text is its closing id alone. Null and repeated
    ids are carried (each row is packed for itself), extra columns ignored; an empty table gives
    an empty table. Documents are packed with others of their input partition, without an
    exchange; ``sequence_id`` holds the partition above 32 bits.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(shared.value), TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[np.ndarray] = []
        total, last = 0, np.array([END_ID], dtype="<u4")

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first
            held = list(_rows(ids, tokens, first))
            first = max((r[5] for r in held), default=first - 1) + 1
            for at in range(0, len(held), 1024):
                columns = list(zip(*held[at : at + 1024]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                tokens.append(np.concatenate((encode(text.as_py() or ""), last)))
                total += len(tokens[-1])
                if total >= CHUNK:
                    yield from flush()
                    ids, tokens, total = [], [], 0
                    give_back()
        if ids:
            yield from flush()
        ids, tokens = [], []
        give_back()

    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return only.mapInArrow(run, _SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """``pieces`` with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
