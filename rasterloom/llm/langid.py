"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot i of a table holds one bit for each of up
to 64 languages (further languages take further tables), so each n-gram of a text is looked up
once for all languages, and the bitwise AND of its slots names the languages that contain it.
Per-language popcounts over the text, corrected for the filters' false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, give_back

#: Documents per language, at most, that the filters are fitted on; all their n-grams are put in.
SAMPLE = 2000
#: Length of n-grams, slots of a filter for each n-gram of the language that has most, log2 of its least slots, its hash functions.
N = 4
ROOM = 20
SLOT_BITS = 22
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: An n-gram goes to a language where it is at least this share as frequent as anywhere.
SHARE = 0.3
UNKNOWN = "und"
#: Share of what a language's sample covers that a text in it holds at least, give or take so many standard
#: deviations of the share among its n-grams, of which every N tell as much as one; and how
#: likely it is at least, in a language, that a text in it holds none of its n-grams at all.
LEAST_SCORE, DEVIATIONS, CHANCE = 0.25, 2.0, 0.05
#: Characters looked up at a time.
BLOCK = 1 << 20


class Model(NamedTuple):
    languages: list[str]
    bits: int  # log2 of the slots
    slots: list[np.ndarray]  # bit l of slots[t][i]: language 64 t + l has an n-gram that hashes to i
    false_rate: np.ndarray
    coverage: np.ndarray  # expected share of the n-grams of further texts of the language that its sample holds
    fold: np.ndarray


def folding() -> np.ndarray:
    """Of every code point its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str, fold: np.ndarray, n: int = N, block: int = BLOCK) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of the folded text, spaces around and single spaces inside, in blocks."""
    space, mix = np.uint32(32), [np.uint64(pow(0x100000001B3, i + 1, 1 << 64)) for i in range(n)]
    kept = np.full(1, space, dtype=np.uint32)
    for at in range(0, len(text) + 1, block):
        part = fold[np.frombuffer(text[at : at + block].encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if at + block > len(text):
            part = np.append(part, space)
        joined = np.concatenate((kept, part))
        gap = joined == space
        joined = joined[np.concatenate(([True], ~(gap[1:] & gap[:-1])))].astype(np.uint64)
        if len(joined) >= n:
            found = joined[: len(joined) - n + 1] * mix[0]
            for i in range(1, n):
                found += joined[i : len(joined) - n + 1 + i] * mix[i]
            found ^= found >> np.uint64(29)
            yield found
        kept = joined[-(n - 1) :].astype(np.uint32) if n > 1 else joined[:0].astype(np.uint32)


def _slot(hashes: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
    return (hashes * np.uint64(multiplier)) >> np.uint64(64 - bits)


def held_out(id_col: str) -> Column:
    """Whether a document is out of the training fold; a null id is, as its fold is unknown."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit the filters on at most ``sample`` labelled training documents per language, chosen by hash.

    Rows with a null text or label and rows of the held-out fold are not learned from. With no
    label at all the model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = rows.select("id", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("held"))
    likely = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1.5 * sample + 100) / F.col("held") * (1 << 30)
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id")
    chosen = labelled.join(F.broadcast(counts), "lang").where(likely).select("id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).select("id", F.col("lang").alias("as_lang")).distinct()
    same = (F.col("id") == F.col("as_id")) & (F.col("lang") == F.col("as_lang"))
    learned = rows.join(F.broadcast(chosen.withColumnRenamed("id", "as_id")), same, "left_semi")  # `sample` rows for each language at most
    fold = folding()
    shared = docs.sparkSession.sparkContext.broadcast(fold)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                for found in grams(text.as_py(), shared.value):
                    values, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(values)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
        give_back()

    counting = lambda texts: texts.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = cut(counting(learned))
    # Each distinct word once, so that copies and repeated lines do not pass for further text; leaving out one n-gram, the rest has it if it is there again.
    words = learned.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()
    words = words.groupBy("lang", F.pmod(F.xxhash64("word"), F.lit(16)).alias("part")).agg(F.concat_ws(" ", F.sort_array(F.collect_list("word"))).alias("text"))
    again = {r["lang"]: r["again"] for r in counting(words).groupBy("lang").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("again")).collect()}
    total = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(total)
    slots, filled, coverage, bits = [], [], [], SLOT_BITS
    if languages:
        number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
        table = counted.select(number.cast("int").alias("lang"), "gram", "n").toPandas()
        rate = table["n"] / table.groupby("lang")["n"].transform("sum")
        within = table[rate >= SHARE * rate.groupby(table["gram"]).transform("max")]
        by_language = dict(list(within.groupby("lang")))
        bits = max(SLOT_BITS, int(ROOM * max(map(len, by_language.values()))).bit_length())
        for first in range(0, len(languages), 64):
            here = languages[first : first + 64]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(here) <= np.dtype(k).itemsize * 8)
            masks = np.zeros(1 << bits, dtype=kind)
            for i, lang in enumerate(here):
                held = by_language.get(first + i, within[:0])
                coverage.append(again.get(lang, 0.0) * float(held["n"].sum()) / total[lang])
                own = held["gram"].to_numpy().astype(np.int64).view(np.uint64)
                for multiplier in MULTIPLIERS:
                    masks[_slot(own, multiplier, bits)] |= kind(1 << i)
                filled.append(float(((masks >> kind(i)) & kind(1)).mean()))
            slots.append(masks)
    return Model(languages, bits, slots, np.array(filled) ** len(MULTIPLIERS), np.array(coverage), fold)


def _judge(text: str | None, model: Model) -> tuple[str, float, np.ndarray, int]:
    """Language, score, the share of the text's n-grams in each language, and their number."""
    none = np.zeros(len(model.languages))
    if not model.languages:
        return UNKNOWN, 0.0, none, 0
    letters, hits = 0, np.zeros(len(model.languages), dtype=np.int64)
    for found in grams(text or "", model.fold):
        letters += len(found)
        at = [_slot(found, multiplier, model.bits) for multiplier in MULTIPLIERS]
        for t, slots in enumerate(model.slots):
            masks = slots[at[0]]
            for other in at[1:]:
                masks &= slots[other]
            here = hits[64 * t : 64 * t + 64]
            if masks.dtype == np.uint8:
                per_mask = np.bincount(masks, minlength=256)
                here += [int(per_mask[(np.arange(256) >> i) & 1 == 1].sum()) for i in range(len(here))]
            else:
                here += [int(((masks >> masks.dtype.type(i)) & masks.dtype.type(1)).sum()) for i in range(len(here))]
    if not letters and text:  # fewer characters than an n-gram has
        known = any(model.fold[ord(c)] != 32 for c in text)
        return (model.languages[0] if known else UNKNOWN, 0.0, none, 0)
    if not letters:
        return UNKNOWN, 0.0, none, 0
    share = np.clip((hits / letters - model.false_rate) / (1 - model.false_rate), 0.0, 1.0)
    best = int(np.argmax(share))
    return model.languages[best], float(share[best]), share, letters


def _shared(docs: DataFrame, model: Model) -> Broadcast:
    """The model as a plain tuple, which workers without this package can read."""
    return docs.sparkSession.sparkContext.broadcast(tuple(model))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` for every row, from the whole text alone.

    ``score`` is the share of the text's n-grams that the language contains, corrected for false
    positives. A null text and one without a letter get ``und`` and 0; ties go to the language
    that sorts first, so a text with letters of which no language knows an n-gram gets the first
    of all with a score of 0. Rows, null and repeated ids are kept; extra columns are ignored.
    """
    shared = _shared(docs, model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            said = [_judge(t.as_py(), own) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=["doc_id", "lang_pred", "score"])
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that are in no learned language; a null label is filled in.

    A row goes if its prediction is ``und``, or if each language's share of its n-grams is below
    ``least`` of what that language's sample is expected to cover (a language of few labelled
    texts cannot know more of a clean one) by more than chance: :data:`DEVIATIONS` standard
    deviations, which leaves room to short texts and none to long ones. No known n-gram at all
    is taken for chance down to a likelihood of :data:`CHANCE`. Only texts go to Python;
    all other columns, whatever their names, stay in the JVM and are returned as they are.
    """
    shared = _shared(docs, model)

    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        enough = least * own.coverage
        for texts in columns:
            langs: list[str | None] = []
            for text in texts:
                lang, _, share, n = _judge(text.as_py(), own)
                slack = DEVIATIONS * np.sqrt(enough * (1 - enough) * N / max(n, 1))
                fits = (share >= enough - slack) & ((share > 0) | ((1 - own.coverage) ** (n / N) >= CHANCE))
                langs.append(lang if lang != UNKNOWN and bool(fits.any()) else None)
            yield pa.array(langs, pa.string())
        give_back()

    judge.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    said = F.arrow_udf(judge, "string").asNondeterministic()  # so that it is not evaluated again for the filter
    judged = docs.select(F.struct("*").alias("row"), said(F.col(text_col).cast("string")).alias("said")).where("said is not null")
    return judged.select(*(F.coalesce(F.col("row")[c].cast("string"), "said").alias(c) if c == lang_col else F.col("row")[c].alias(c) for c in docs.columns))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` with filters fitted on the training fold of ``docs``.

    Null, empty and repeated rows as in :func:`predict`; an empty table gives an empty table.
    """
    found = predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
