"""Language identification by bit-sliced Bloom filters.

All languages' filters lie in one table: a position holds a mask with a bit for each language, so the AND of an
n-gram's positions is the set of all languages that contain it. A language's popcount over a text, less what
its filter's false positives add, is its evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

GRAM = 4
HASHES = 3
#: Positions of a filter for each n-gram of the language that has most; fuller filters only let more strange n-grams pass, which is corrected for.
ROOM, MOST_POSITIONS = 24, 1 << 20
#: A language has the n-grams that occur once at least in so many of its training documents.
RARE = 2000
#: Training documents of a language at most, chosen by a hash of doc_id.
TRAINING_DOCUMENTS = 10_000
#: Languages whose sizes are broadcast at most, some 50 bytes each.
BROADCAST_LANGUAGES = 20_000
FOLDS, HELD_OUT = 5, 0


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's n-grams: lower-cased letters, each run of anything else as one blank."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    if not letter.any():
        return np.zeros(0, np.uint64)
    code = np.pad(code, (0, max(GRAM - len(code), 0)), constant_values=32)
    h = np.zeros(len(code) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = (h ^ code[k : len(code) - GRAM + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class BitSlicedFilters:
    """One Bloom filter for each language, sliced by position; masks of 64 languages a word."""

    def __init__(self, languages: list[str], positions: int = 1 << 18):
        self.languages, self.positions = languages, positions
        self.slices = np.zeros((max(1, -(-len(languages) // 64)), positions), np.uint64)

    @staticmethod
    def places(h: np.ndarray, positions: int) -> list[np.ndarray]:
        return [((h >> np.uint64(20 * k)) & np.uint64(positions - 1)).astype(np.int64) for k in range(HASHES)]

    def add(self, language: str, h: np.ndarray) -> None:
        for at in self.places(h, self.positions):
            self.set(language, at)

    def set(self, language: str, at: np.ndarray) -> None:
        word, bit = divmod(self.languages.index(language), 64)
        self.slices[word, at] |= np.uint64(1) << np.uint64(bit)

    def false_rates(self) -> np.ndarray:
        """Of each language: the share of strange n-grams that its filter lets pass."""
        fill = [np.count_nonzero(self.slices[w] >> np.uint64(b) & np.uint64(1)) / self.positions for w, b in (divmod(i, 64) for i in range(len(self.languages)))]
        return np.minimum(np.array(fill) ** HASHES, 0.999)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as words of bits."""
        at = self.places(h, self.positions)
        out = self.slices[:, at[0]]
        for more in at[1:]:
            out &= self.slices[:, more]
        return out

    def evidence(self, h: np.ndarray, rates: np.ndarray) -> np.ndarray:
        found = self.masks(h)
        hits = np.array([np.count_nonzero(found[w] >> np.uint64(b) & np.uint64(1)) for w, b in (divmod(i, 64) for i in range(len(self.languages)))], float)
        return np.maximum((hits - rates * len(h)) / (1 - rates), 0)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def profiles(documents: DataFrame) -> DataFrame:
    """(lang, h): every n-gram of each language in its training documents (doc_id, text, lang) that isn't rarer than RARE.

    No text is shuffled: the languages' sizes go to the documents unless there are very many languages.
    """
    known = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out())
    sizes = written(known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")), "languages")
    few = sizes.count() <= BROADCAST_LANGUAGES
    share = F.lit(1_000_000.0 * TRAINING_DOCUMENTS) / F.col("docs")
    chosen = known.join(F.broadcast(sizes) if few else sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                h, n = np.unique(np.concatenate([grams(t) for t in part["text"]]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "h": h.view(np.int64), "n": n})

    totals = chosen.select("lang", "text").mapInPandas(counted, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    least = F.least(F.col("docs"), F.lit(TRAINING_DOCUMENTS)) / RARE
    return written(totals.join(F.broadcast(sizes) if few else sizes, "lang").where(F.col("n") >= least).select("lang", "h"), "profiles")


def trained(documents: DataFrame) -> BitSlicedFilters:
    """Filters of the languages' n-grams, as large as these need; positions are found by tasks, so MOST_POSITIONS a language reach the driver at most."""
    known = profiles(documents)
    kinds = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each language
    positions = min(MOST_POSITIONS, 1 << ceil(log2(ROOM * max(kinds.values(), default=1))))
    filters = BitSlicedFilters(sorted(kinds), positions)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.concatenate(BitSlicedFilters.places(pdf["h"].to_numpy(np.int64).view(np.uint64), positions))
            yield pd.DataFrame({"lang": np.tile(pdf["lang"].to_numpy(), HASHES), "at": at})

    filled = known.mapInPandas(placed, "lang string, at int").distinct().toPandas()
    for lang, part in filled.groupby("lang"):
        filters.set(lang, part["at"].to_numpy(np.int64))
    return filters


def languages(documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of documents (doc_id, text, lang).

    score: the language's part of all languages' evidence. `und` with score 0 where the text is null, has no
    letter, or nothing is learned; texts whose n-grams are all strange get the first language with score 0.
    Of equal evidence the first language by name wins. Rows that repeat a doc_id are judged each; very long texts
    are read whole, other columns not at all, whatever their names. An empty table gives no rows.
    """
    filters = trained(documents)
    rates = filters.false_rates()

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pred, score = [], []
            for text in pdf["text"]:
                h = grams(text)
                e = filters.evidence(h, rates) if len(h) and filters.languages else None
                pred.append("und" if e is None else filters.languages[int(e.argmax())])
                score.append(0.0 if e is None or not e.sum() else float(e.max() / e.sum()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": pred, "score": score})

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(judged, "doc_id long, held_out boolean, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
