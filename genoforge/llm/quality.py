"""Quality scores by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Class covariances are (1 - POOL - RIDGE) own + POOL pooled + RIDGE identity, of standardised statistics.
POOL, RIDGE = 0.2, 0.05
#: Labelled documents that the classifier is fitted on at most, chosen by a hash of doc_id; some 16 bytes each go to every task.
LABELLED = 200_000
FOLDS, HELD_OUT = 3, 1

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_spread", "unique_words", "unique_triples", "upper", "digits", "stops", "symbols",
    "not_ascii", "spaces", "entropy", "packed", "capitals", "shouted", "short_words", "long_words", "log_lines", "unique_lines", "alone",
]
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, list(b".,;:?'\"-()"))
_SYMBOL = (_BYTES > 32) & (_BYTES < 127) & ~_STOP & ~_DIGIT & ~_UPPER & ~((_BYTES >= 97) & (_BYTES <= 122))


def _odds(share: float) -> float:
    """A share as log odds, with 0 and 1 drawn in."""
    p = min(max(share, 0.0), 1.0) * 0.998 + 0.001
    return float(np.log(p / (1 - p)))


def statistics(text: str | None) -> list[float]:
    """STATISTICS of a whole text; a null or empty one has one of each kind of zero."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    p = counts[counts > 0] / n
    triples = max(len(words) - 2, 1)
    seen = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 1
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(lengths.mean()), np.log1p(lengths.std()),
        _odds(len(set(words)) / w), _odds(seen / triples),
        _odds(counts[_UPPER].sum() / n), _odds(counts[_DIGIT].sum() / n), _odds(counts[_STOP].sum() / n), _odds(counts[_SYMBOL].sum() / n),
        _odds(counts[128:].sum() / n), _odds(counts[_SPACE].sum() / n), float(-(p * np.log(p)).sum()) if len(raw) else 0.0,
        np.log(len(zlib.compress(raw, 1)) / n + 0.01) if len(raw) else 0.0,
        _odds(sum(map(bytes.istitle, words)) / w), _odds(sum(map(bytes.isupper, words)) / w),
        _odds(np.count_nonzero(lengths <= 3) / w), _odds(np.count_nonzero(lengths > 12) / w),
        np.log1p(len(lines)), _odds(len(set(lines)) / len(lines)), _odds(np.count_nonzero(lengths == 1) / w),
    ]


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": [statistics(t) for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(rows, "doc_id long, x array<double>")


class Discriminant:
    """Two Gaussian classes with their Cholesky factors; scores are log-density differences."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """moments: by class, rows, sum of x and sum of x xᵀ."""
        n = sum(m[0] for m in moments.values())
        self.mean = sum(m[1] for m in moments.values()) / n
        within = {c: s2 / k - np.outer(s / k, s / k) for c, (k, s, s2) in moments.items()}
        pooled = sum(moments[c][0] / n * v for c, v in within.items())
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        shape = np.outer(self.scale, self.scale)
        self.classes = {}
        for c, (k, s, _) in moments.items():
            cov = (1 - POOL - RIDGE) * within[c] / shape + POOL * pooled / shape + RIDGE * np.eye(len(s))
            factor = np.linalg.cholesky(cov)
            constant = np.log(k / n) - np.log(np.diag(factor)).sum()
            self.classes[c] = ((s / k - self.mean) / self.scale, np.linalg.inv(factor), constant)

    def log_density(self, z: np.ndarray, c: int) -> np.ndarray:
        at, whiten, constant = self.classes[c]
        return constant - 0.5 * (((z - at) @ whiten.T) ** 2).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; with one class only, that class for certain; 0.5 with none."""
        if len(self.classes) < 2:
            return np.full(len(x), 1.0 if 1 in self.classes else 0.0)
        z = (x - self.mean) / self.scale
        gap = np.clip(self.log_density(z, 1) - self.log_density(z, 0), -500, 500)
        return 1 / (1 + np.exp(-gap))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labels outside the held-out fold, about LABELLED at most, chosen by a hash of doc_id."""
    known = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = min(1.0, LABELLED / max(labels.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * share))


def fitted(points: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant of the labelled points; their ids are few enough to be sent to the points, sums are made by task, then added up."""
    d = len(STATISTICS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for pdf in batches:
            for c, part in pdf.groupby("quality"):
                x = np.stack([*part["x"]])
                add = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total[c] = total.get(c, 0) + add
        for c, v in total.items():
            yield pd.DataFrame({"quality": c, "k": np.arange(len(v)), "v": v})

    parts = points.join(F.broadcast(labelled(labels)), "doc_id").select("quality", "x").mapInPandas(sums, "quality int, k int, v double")
    found = parts.groupBy("quality", "k").agg(F.sum("v").alias("v")).toPandas()  # 2 (1 + d + d²) numbers
    moments = {}
    for c, part in found.groupby("quality"):
        v = part.sort_values("k")["v"].to_numpy()
        moments[int(c)] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return Discriminant(moments) if moments else None


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of documents (doc_id, text).

    labels: (doc_id, quality); other values than 0 and 1 are left out, LABELLED are used, of several labels of a doc_id the least counts.
    Null and empty texts are scored by their statistics; without any label every score is 0.5. Rows that
    repeat a doc_id are scored each; a null doc_id is never held out; a score of exactly 0.5 is predicted 1. Very
    long texts are measured whole; other columns are not read, whatever their names. An empty table gives no rows.
    """
    points = written(measured(documents), "statistics")
    model = fitted(points, labels)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack([*pdf.pop("x")]) if len(pdf) else np.zeros((0, len(STATISTICS)))
            yield pdf.assign(score=model.score(x) if model else 0.5)

    rows = points.select("doc_id", held_out().alias("held_out"), "x").mapInPandas(scored, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, whose score is 0.5 or more; texts stay where they are."""
    model = fitted(measured(documents.select("doc_id", "text").join(F.broadcast(labelled(labels)), "doc_id", "left_semi")), labels)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        if not len(texts) or model is None:
            return pd.Series(np.ones(len(texts), bool))
        return pd.Series(model.score(np.array([statistics(t) for t in texts])) >= 0.5)

    return documents.where(good("text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
