"""Language identification by language-bitmask n-gram filters.

Every letter trigram that is typical of a language sets that language's bit in the slots of a bit-sliced
Bloom filter: slot s holds one bit a language, so one lookup of a trigram (AND over its slots) returns all
languages that contain it. A text's trigrams give a popcount a language, the expected false positives of
that language's slice are taken off, and the largest share wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.common import crc_mod, map_texts, slices, staged, text_bytes

HASHES = 3
#: Slots for each trigram of the language with most of them, and the most bytes that the filter may have.
ROOM, MAX_BYTES = 8, 128 << 20
#: A trigram belongs to each language whose rate of it is at least this share of the highest rate.
TYPICAL = 0.25
#: Rarer trigrams of a language are not learned, so that a language has 1 / RARE of them at most.
RARE = 1e-6
#: Characters looked at together, trigrams counted together, and slots that one row of the filter holds.
PIECE, HELD, SEGMENT_BITS = 1 << 16, 1 << 20, 12
LETTER = regex.compile(r"\p{L}")
#: Odd multipliers of the slot hashes.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Trigrams of the lower-cased text, a piece of it at a time, as code points packed in 63 bits; other signs
    than letters become one blank each, and trigrams with a blank in the middle are left out."""
    signs = f" {text.decode().lower()} "
    for start in range(0, len(signs) - 2, PIECE):
        points = np.frombuffer(signs[start : start + PIECE + 2].encode("utf-32-le"), "<u4").astype(np.uint64)
        letter = ((points >= 97) & (points <= 122)) | ((points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ~((points >= 0x2000) & (points < 0x2C00)))
        points[~letter] = 32
        packed = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
        yield packed[letter[1:-1]]


def slots(grams: np.ndarray, bits: int) -> np.ndarray:
    """(HASHES, n) slots of the trigrams, of 2 ** ``bits``."""
    return np.stack([((grams * m) ^ ((grams * m) >> np.uint64(29))) * SPREAD[0] >> np.uint64(64 - bits) for m in SPREAD])


def slot_bits(grams: int, words: int) -> int:
    """Enough for ROOM slots a trigram of the largest language, within MAX_BYTES. Where those do not suffice the
    slices fill up, and the correction for false positives has more to take off."""
    room = max(SEGMENT_BITS, int(np.ceil(np.log2(max(1, ROOM * grams)))))
    return max(SEGMENT_BITS, min(room, int(np.log2(MAX_BYTES / (8 * max(1, words))))))


@dataclass
class LanguageFilter:
    """masks: (words, slots), a bit for each language in every slot, 64 languages a word. false: per language, the
    chance that a foreign trigram passes its slice."""

    languages: list[str]
    masks: np.ndarray
    false: np.ndarray
    common: int

    def shares(self, text: bytes) -> np.ndarray:
        """Per language, the share of the text's trigrams in it, less the false positives."""
        passed, n, bits = np.zeros(len(self.languages)), 0, int(self.masks.shape[1]).bit_length() - 1
        for grams in trigrams(text):
            at = slots(grams, bits)
            n += len(grams)
            for word, masks in enumerate(self.masks):
                found = masks[at[0]]
                for row in at[1:]:
                    found &= masks[row]
                for k in range(64 * word, min(64 * word + 64, len(passed))):
                    passed[k] += np.count_nonzero(found & np.uint64(1 << (k & 63)))
        if not n:
            return passed
        return np.clip((passed / n - self.false) / (1 - self.false + 1e-12), 0, 1)


def count_trigrams(known: DataFrame, lang_col: str) -> DataFrame:
    """(lang, gram, n) of all rows."""

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        fresh: dict[str, list[np.ndarray]] = {}
        waiting = 0

        def merge() -> None:
            for lang, found in fresh.items():
                old, seen = total.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                more, n = np.unique(np.concatenate(found), return_counts=True)
                keys, where = np.unique(np.concatenate([old, more]), return_inverse=True)
                total[lang] = keys, np.bincount(where, np.concatenate([seen, n]), len(keys)).astype(np.int64)
            fresh.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            total.clear()

        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for grams in trigrams(text):
                    fresh.setdefault(lang, []).append(grams)
                    waiting += len(grams) + 64
                    if waiting > HELD:
                        merge()
                        waiting = 0
            if sum(len(keys) for keys, _ in total.values()) > HELD:  # counts add up downstream, so they may leave in parts
                yield from told()
        merge()
        yield from told()

    parts = known.select(F.col(lang_col).cast("string").alias("lang"), text_bytes(known, "text").alias("text")).mapInArrow(count, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang_col: str = "lang") -> LanguageFilter:
    """Learn from text and non-null ``lang_col`` of all rows of ``docs``.

    Trigram counts merge in Spark; the driver gets one row a language and the filter, MAX_BYTES at most. A slot
    has a bit for each language, in as many words as that takes. Where no text has a letter no language is
    known."""
    counts = staged(count_trigrams(docs.where(F.col(lang_col).isNotNull()), lang_col), "language-trigrams")
    sums = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    told = sorted((row.lang, row.total) for row in sums.collect())  # a row a language
    languages = [lang for lang, _ in told]
    if not languages:
        return LanguageFilter([], np.zeros((0, 1 << SEGMENT_BITS), np.uint64), np.zeros(0), -1)
    numbered = docs.sparkSession.createDataFrame([(lang, k, float(total)) for k, (lang, total) in enumerate(told)], "lang string, k int, total double")
    rated = counts.join(numbered, "lang").select("gram", "k", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= RARE)
    top = F.max("rate").over(Window.partitionBy("gram"))  # a row a language at most
    typical = staged(rated.withColumn("top", top).where(F.col("rate") >= TYPICAL * F.col("top")).select("gram", "k"), "language-typical")
    largest = typical.groupBy("k").count().agg(F.max("count")).first()[0] or 0
    words = -(-len(languages) // 64)
    bits = slot_bits(largest, words)

    def spread(batches):
        for batch in batches:
            at = slots(np.asarray(batch.column(0)).view(np.uint64), bits).ravel().astype(np.int64)
            k = np.tile(np.asarray(batch.column(1)).astype(np.int64), HASHES)
            word, bit = k >> 6, (np.uint64(1) << (k & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (word, at >> SEGMENT_BITS, at & ((1 << SEGMENT_BITS) - 1), bit)], names=["word", "segment", "slot", "bit"])

    def fill(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        masks = np.zeros(1 << SEGMENT_BITS, np.uint64)
        np.bitwise_or.at(masks, group.column("slot").to_numpy(), group.column("bit").to_numpy().view(np.uint64))
        return pa.table({"word": [key[0].as_py()], "segment": [key[1].as_py()], "masks": pa.array([masks.tobytes()], pa.binary())})

    bits_of = typical.mapInArrow(spread, "word long, segment long, slot long, bit long").groupBy("word", "segment", "slot").agg(F.bit_or("bit").alias("bit"))
    filled = bits_of.groupBy("word", "segment").applyInArrow(fill, "word long, segment long, masks binary")
    masks = np.zeros((words, 1 << (bits - SEGMENT_BITS), 1 << SEGMENT_BITS), np.uint64)
    for row in filled.toLocalIterator():
        masks[row.word, row.segment] = np.frombuffer(row.masks, np.uint64)
    masks = masks.reshape(words, -1)
    share = np.array([np.count_nonzero(masks[k >> 6] & np.uint64(1 << (k & 63))) for k in range(len(languages))]) / masks.shape[1]
    return LanguageFilter(languages, masks, share**HASHES, max(range(len(languages)), key=lambda k: told[k][1]))


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of each row: the language of the largest share, ties to the first by name.

    score: that share over the sum of shares. Texts that are null or have no letter, and all texts of a
    model without languages, give ``und`` and 0; letters that no filter knows give the language with most
    training text, and 0."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # MAX_BYTES at most

    def make():
        known = spread.value

        def step(part: pa.RecordBatch) -> dict:
            names, scores = [], []
            for text in part.column(1).to_pylist():
                if not known.languages or not LETTER.search(text.decode()):
                    names.append("und")
                    scores.append(0.0)
                    continue
                share = known.shares(text)
                total = float(share.sum())
                best = int(np.argmax(share)) if total > 0 else known.common
                names.append(known.languages[best])
                scores.append(float(share[best]) / total if total > 0 else 0.0)
            return {"doc_id": part.column(0), "lang_pred": names, "score": scores}

        return step

    return map_texts(docs, [F.col(id_col).cast("long").alias("doc_id"), text_bytes(docs, "text").alias("text")], "doc_id long,lang_pred string,score double", make)


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows whose crc32(doc_id) mod 5 is not 0.

    Null languages are not learned from; null ids count as the id '' for the split; repeated rows are
    predicted each; an empty table gives no rows. Other columns are not read."""
    model = train(docs.where(crc_mod("doc_id", 5) != 0))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
