"""Exact removal of repeated word windows by super-k-mer partitioning.

A window's minimiser is the smallest hash of the word n-grams in it, so equal windows have equal minimisers, and
consecutive windows that share one are a super-k-mer. First only minimisers travel, to find those of more than
one document. Super-k-mers of these then travel as packed strings, equal ones made one on the way, to their
minimiser's bucket, where sorting their windows gives the smallest document that has each. A bucket of too many
different strings is cut again by minimisers of longer n-grams; those as long as a window name it alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, table, written

WINDOW = 13
#: Words of the n-grams that minimisers are taken of; the next ones cut buckets that are too large, the last are whole windows.
GRAMS = (5, 9, 13)
#: Windows in one packed string at most; a longer run of windows is cut.
LONGEST = 64
#: Different strings that one bucket takes; a larger one is cut by longer n-grams.
BUCKET = 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


_hashes = _WordHashes()


def minimisers(words: list[bytes], gram: int) -> np.ndarray:
    """The minimiser of the window that starts at each word."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(len(w) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * _ODD + w[k : len(w) - gram + 1 + k]
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h ^= h >> np.uint64(31)
    low = h[: len(w) - WINDOW + 1].copy()
    for k in range(1, WINDOW - gram + 1):
        np.minimum(low, h[k : k + len(low)], out=low)
    return low


def super_kmers(words: list[bytes], gram: int) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first window, windows) of each run of windows with one minimiser; n-grams as long as a window name each alone."""
    low = minimisers(words, gram)
    if not len(low):
        return
    longest = 1 if gram == WINDOW else LONGEST
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(low)]):
        for at in range(a, b, longest):
            yield int(low[a].view(np.int64)), at, min(longest, b - at)


def windows(packed: bytes) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]


def read(documents: DataFrame) -> DataFrame:
    """Each row's words: how many, the digest of all, its distinct minimisers, and the words themselves compressed."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = (text or "").encode("utf-8", "replace").split()
                whole = b" ".join(words)
                out.append((len(words), hashlib.sha256(whole).hexdigest(), np.unique(minimisers(words, GRAMS[0])).view(np.int64), press.compress(whole)))
            n, sha, mins, body = zip(*out) if out else ((), (), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "n_words": n, "sha": sha, "mins": mins, "body": body})

    return documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInPandas(
        rows, "doc_id long, row long, n_words long, sha string, mins array<long>, body binary")


def cut(shared: DataFrame) -> DataFrame:
    """(row, doc_id, first, bucket, packed) of the super-k-mers with one of the row's shared minimisers."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for row, doc_id, body, mins in zip(pdf["row"], pdf["doc_id"], pdf["body"], pdf["mins"]):
                words, wanted = open_.decompress(body).split(b" "), set(mins.tolist())
                out += [(row, doc_id, at, m, b" ".join(words[at : at + k + WINDOW - 1])) for m, at, k in super_kmers(words, GRAMS[0]) if m in wanted]
            yield pd.DataFrame(out, columns=["row", "doc_id", "first", "bucket", "packed"])

    return shared.mapInPandas(rows, "row long, doc_id long, first int, bucket long, packed binary")


def cut_again(strings: DataFrame, gram: int) -> DataFrame:
    """(whole, at, bucket, packed, low, high): strings (key, packed, low, high) by minimisers of longer n-grams."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, packed, low, high in zip(pdf["key"], pdf["packed"], pdf["low"], pdf["high"]):
                words = packed.split(b" ")
                out += [(key, at, m, b" ".join(words[at : at + k + WINDOW - 1]), low, high) for m, at, k in super_kmers(words, gram)]
            yield pd.DataFrame(out, columns=["whole", "at", "bucket", "packed", "low", "high"])

    return strings.select("key", "packed", "low", "high").mapInPandas(rows, "whole binary, at int, bucket long, packed binary, low long, high long")


def keyed(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("key", F.unhex(F.md5("packed")))


def sorted_buckets(strings: DataFrame) -> DataFrame:
    """(key, at, lows): for windows at, at + 1 ... of a string (bucket, key, packed, low, high) the smallest `low` of all strings with them.

    Tasks read whole buckets in order and hold one at a time. Strings without a window that a document before
    `high` has as well are left out.
    """

    def bucket(rows: list[tuple[bytes, bytes, int, int]]) -> Iterator[tuple[bytes, int, list[int]]]:
        if len(rows) == 1 and rows[0][2] == rows[0][3]:
            return
        cut_up = sorted((w, low, k, i) for k, (_, packed, low, _) in enumerate(rows) for i, w in enumerate(windows(packed)))
        lows: list[dict[int, int]] = [{} for _ in rows]
        before, least = None, 0
        for w, low, k, i in cut_up:
            if w != before:
                before, least = w, low
            lows[k][i] = least
        for (key, _, _, high), found in zip(rows, lows):
            if any(x < high for x in found.values()):
                yield key, 0, [found[i] for i in range(len(found))]

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, names = None, [], ["key", "at", "lows"]
        for pdf in batches:
            out = []
            for m, *string in zip(pdf["bucket"], pdf["key"], pdf["packed"], pdf["low"], pdf["high"]):
                if m != at:
                    out += bucket(held)
                    at, held = m, []
                held.append(string)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(bucket(held)), columns=names)

    n = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return strings.select("bucket", "key", "packed", "low", "high").repartition(n, "bucket").sortWithinPartitions("bucket").mapInPandas(tasks, "key binary, at int, lows array<long>")


def earliest(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(key, at, lows) of the packed strings of pieces (bucket, packed, low, high) of which a document may lose words."""
    strings = written(pieces.groupBy("bucket", "packed").agg(F.min("low").alias("low"), F.max("high").alias("high")), "strings")
    if level == len(GRAMS) - 1:  # each string is a window and alone in its bucket
        return keyed(strings).where("low < high").select("key", F.lit(0).alias("at"), F.array("low").alias("lows"))
    large = written(strings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select("bucket"), "large")
    lows = written(sorted_buckets(keyed(strings.join(large, "bucket", "left_anti"))), "lows")
    if large.limit(1).count():
        again = keyed(written(cut_again(keyed(strings.join(large, "bucket", "left_semi")), GRAMS[level + 1]), "again"))
        found = again.join(earliest(again, level + 1).withColumnRenamed("at", "then"), "key")
        lows = lows.union(written(found.select(F.col("whole").alias("key"), (F.col("at") + F.col("then")).alias("at"), "lows"), "lows"))
    discarded(strings)
    return lows


def repeats_removed(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of documents (doc_id, text).

    Removes each word in a window of WINDOW consecutive words that also starts in a row with a smaller doc_id. Null
    texts have no words; shorter texts and rows without a doc_id keep all theirs, and the latter make no other row
    lose any. Rows that share a doc_id don't affect each other. Very long texts are read whole; other columns not
    at all, whatever their names. An empty table gives no rows.
    """
    docs = written(read(documents), "words")
    grams = docs.where("doc_id is not null").select("row", F.explode("mins").alias("minimiser"))
    shared = grams.groupBy("minimiser").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("minimiser")
    wanted = written(grams.join(shared, "minimiser").groupBy("row").agg(F.collect_list("minimiser").alias("mins")), "wanted")
    heads = written(docs.select("row", "doc_id", "n_words", "sha"), "heads")
    touched = written(docs.select("row", "doc_id", "body").join(wanted, "row"), "touched")
    discarded(docs, wanted)
    pieces = written(cut(touched), "pieces")
    lows = earliest(pieces.select("bucket", "packed", F.col("doc_id").alias("low"), F.col("doc_id").alias("high")))
    marks = keyed(pieces).select("row", "doc_id", "first", "key").join(lows, "key").where(F.exists("lows", lambda x: x < F.col("doc_id")))
    places = F.filter(F.transform("lows", lambda x, i: F.when(x < F.col("doc_id"), i + F.col("first") + F.col("at"))), lambda x: x.isNotNull())
    hits = marks.select("row", F.transform(places, lambda x: x.cast("int")).alias("at"))
    found = written(hits.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("at")), "found")
    discarded(pieces)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for row, body, at in zip(pdf["row"], pdf["body"], pdf["at"]):
                words = np.array(open_.decompress(body).split(b" "), object)
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, at, 1)
                np.add.at(edges, np.asarray(at) + WINDOW, -1)
                gone = np.cumsum(edges)[:-1] > 0
                out.append((row, int(gone.sum()), hashlib.sha256(b" ".join(words[~gone])).hexdigest()))
            yield pd.DataFrame(out, columns=["row", "n_removed", "kept"])

    changed = touched.select("row", "body").join(found, "row").mapInPandas(kept, "row long, n_removed long, kept string")
    return heads.join(changed, "row", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_removed(table(spark, sf_dir, "documents"))
