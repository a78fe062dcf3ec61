"""Exact deduplication on a sharded cuckoo-filter index.

Digests are dealt to shards by their leading bits. A shard stores its live digests (the content that
verifies a hit) by filter bucket, and a cuckoo filter over them: two candidate buckets of four 16-bit
fingerprints. A digest that the filter rejects is new for certain; one that it accepts is looked up in
the content of its bucket. A filter that can't place a fingerprint doubles its buckets and is filled
again from the stored digests.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discarded, shared_dir, table, written

SLOTS = 4
MAX_KICKS = 200
KEYS_PER_SHARD = 2_000
#: Digests that a task sums before it sends them on.
SUMMED = 200_000

KEYS = "shard int, digest string, keep_id long, copies long"
FILTERS = "shard int, buckets int, live long, resizes int, cells binary"


class CuckooFilter:
    """Fingerprints of 64-bit hashes in buckets of four; insertion moves residents, deletion frees a cell."""

    def __init__(self, buckets: int = 64, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = np.frombuffer(cells, "<u2").copy().reshape(buckets, SLOTS) if cells else np.zeros((buckets, SLOTS), "<u2")

    @staticmethod
    def _spread(fingerprint: int) -> int:
        return (fingerprint * 0x5BD1E995) & 0x7FFFFFFF

    def _places(self, h: int) -> tuple[int, int, int]:
        fingerprint = (h >> 48) or 1
        first = h & (self.buckets - 1)
        return fingerprint, first, (first ^ self._spread(fingerprint)) & (self.buckets - 1)

    def __contains__(self, h: int) -> bool:
        f, i, j = self._places(h)
        return f in self.cells[i] or f in self.cells[j]

    def insert(self, h: int) -> bool:
        """False if no cell came free within MAX_KICKS moves; the caller then resizes from the stored keys."""
        f, i, j = self._places(h)
        for at in (i, j):
            for slot in range(SLOTS):
                if not self.cells[at, slot]:
                    self.cells[at, slot] = f
                    return True
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            f, self.cells[i, slot] = int(self.cells[i, slot]), f
            i = (i ^ self._spread(f)) & (self.buckets - 1)
            for free in range(SLOTS):
                if not self.cells[i, free]:
                    self.cells[i, free] = f
                    return True
        return False

    def delete(self, h: int) -> bool:
        f, i, j = self._places(h)
        for at in (i, j):
            for slot in range(SLOTS):
                if self.cells[at, slot] == f:
                    self.cells[at, slot] = 0
                    return True
        return False


def key_hash(digest: str) -> int:
    """64 bits of the digest; the shard takes its own bits from the front, the filter these from the back."""
    return int(digest[-16:], 16)


class Shard:
    """One shard's live digests with their keep_id and number of copies, in buckets, and the filter over them.

    Whether a digest was seen is the filter's to say: what it rejects is stored without a look at the content.
    """

    def __init__(self, filter: CuckooFilter | None = None, resizes: int = 0):
        self.filter, self.resizes = filter or CuckooFilter(), resizes
        self.content: dict[int, dict[str, list]] = {}

    def _bucket(self, h: int) -> int:
        return h & (self.filter.buckets - 1)

    def _found(self, digest: str, h: int) -> list | None:
        return self.content.get(self._bucket(h), {}).get(digest) if h in self.filter else None

    def store(self, digest: str, keep_id: int | None, copies: int) -> None:
        """A digest that the filter holds already."""
        self.content.setdefault(self._bucket(key_hash(digest)), {})[digest] = [keep_id, copies]

    def insert(self, digest: str, keep_id: int | None, copies: int) -> bool:
        """True if the digest is new."""
        h = key_hash(digest)
        if held := self._found(digest, h):
            held[0] = min((x for x in (held[0], keep_id) if x is not None), default=None)
            held[1] += copies
            return False
        self.store(digest, keep_id, copies)
        if not self.filter.insert(h):
            self._resize()
        return True

    def delete(self, digest: str, copies: int) -> None:
        """Takes copies away; a digest without copies leaves the content and frees its fingerprint."""
        h = key_hash(digest)
        if held := self._found(digest, h):
            held[1] -= copies
            if held[1] <= 0:
                del self.content[self._bucket(h)][digest]
                self.filter.delete(h)

    def keys(self) -> Iterator[tuple[str, int | None, int]]:
        return ((d, k, c) for bucket in self.content.values() for d, (k, c) in bucket.items())

    def _resize(self) -> None:
        buckets, keys = self.filter.buckets, list(self.keys())
        while True:
            buckets *= 2
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(key_hash(d)) for d, _, _ in keys):
                break
        self.content = {}
        for key in keys:
            self.store(*key)


class CuckooIndex:
    """An index at a path of the shared folder: `keys` and `filters`, both by shard.

    insert() and delete() write a new version beside the old one and return it, so a failed job leaves the
    index as it was. Tasks sum what they read by digest before they send it on: however many copies a text has,
    its shard gets a row for each task. A shard holds about KEYS_PER_SHARD digests; tasks hold one at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None, shards: int):
        self.spark, self.path, self.shards = spark, path, shards

    @classmethod
    def empty(cls, spark: SparkSession, expected_keys: int) -> CuckooIndex:
        shards = 1
        while shards * KEYS_PER_SHARD < expected_keys:
            shards *= 2
        return cls(spark, None, shards)

    def _shard(self, digest="digest"):
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(self.shards)).cast("int")

    def keys(self) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(f"{self.path}/keys") if self.path else self.spark.createDataFrame([], KEYS)

    def filters(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters") if self.path else self.spark.createDataFrame([], FILTERS)

    def insert(self, digests: DataFrame) -> CuckooIndex:
        """digests: (digest, doc_id), a row for each live document."""
        return self._changed(digests.select("digest", "doc_id"), 2)

    def delete(self, digests: DataFrame) -> CuckooIndex:
        """digests: (digest), a row for each document that goes; digests without live copies are forgotten."""
        return self._changed(digests.select("digest", F.lit(None).cast("long").alias("doc_id")), 3)

    def _changed(self, batch: DataFrame, kind: int) -> CuckooIndex:
        """Old keys, filter and batch of a shard follow each other as rows of one sorted partition."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, list] = {}
            rows = lambda: pa.RecordBatch.from_pydict(
                {"digest": list(seen), "keep_id": [k for k, _ in seen.values()], "copies": [c for _, c in seen.values()]},
                schema=pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("copies", pa.int64())]))
            for some in batches:
                for digest, doc_id in zip(some["digest"].to_pylist(), some["doc_id"].to_pylist()):
                    if held := seen.get(digest):
                        held[0] = min((x for x in (held[0], doc_id) if x is not None), default=None)
                        held[1] += 1
                    else:
                        seen[digest] = [doc_id, 1]
                if len(seen) > SUMMED:
                    yield rows()
                    seen = {}
            yield rows()

        void = [F.lit(None).cast(t).alias(c) for c, t in (("buckets", "int"), ("resizes", "int"), ("cells", "binary"))]
        rows = batch.mapInArrow(summed, "digest string, keep_id long, copies long").select(self._shard().alias("shard"), F.lit(kind).alias("kind"), "digest", "keep_id", "copies", *void)
        if self.path:
            rows = rows.union(self.keys().select("shard", F.lit(1), "digest", "keep_id", "copies", *void)).union(
                self.filters().select("shard", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"), "buckets", "resizes", "cells"))
        out = "kind int, shard int, digest string, keep_id long, copies long, buckets int, live long, resizes int, cells binary"
        columns = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("digest", pa.string()), ("keep_id", pa.int64()), ("copies", pa.int64()), ("buckets", pa.int32()), ("live", pa.int64()), ("resizes", pa.int32()), ("cells", pa.binary())])

        def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, shard = None, Shard()

            def state() -> pa.RecordBatch:
                found = [(1, at, d, k, c, None, None, None, None) for d, k, c in shard.keys()]
                found.append((0, at, None, None, None, shard.filter.buckets, len(found), shard.resizes, shard.filter.cells.tobytes()))
                return pa.RecordBatch.from_pydict(dict(zip(columns.names, map(list, zip(*found)))), schema=columns)

            for some in batches:
                for n, kind, digest, keep_id, copies, buckets, resizes, cells in zip(*[c.to_pylist() for c in some.columns]):
                    if n != at:
                        if at is not None:
                            yield state()
                        at, shard = n, Shard()
                    if kind == 0:
                        shard = Shard(CuckooFilter(buckets, cells), resizes)
                    elif kind == 1:
                        shard.store(digest, keep_id, copies)
                    elif kind == 2:
                        shard.insert(digest, keep_id, copies)
                    else:
                        shard.delete(digest, copies)
            if at is not None:
                yield state()

        path = f"{shared_dir(self.spark)}/cuckoo-{uuid.uuid4().hex}"
        done = written(rows.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(rebuilt, out), "shards")
        done.where("kind = 1").select("shard", "digest", "keep_id", "copies").write.parquet(f"{path}/keys")
        done.where("kind = 0").select("shard", "buckets", "live", "resizes", "cells").write.parquet(f"{path}/filters")
        discarded(done)
        return CuckooIndex(self.spark, path, self.shards)

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digests with keep_id and copies of each live digest, null where there is none.

        The join on the digest is an ordinary one, so Spark splits a hot digest over tasks.
        """
        return digests.join(self.keys().select("digest", "keep_id", "copies"), "digest", "left")

    def probe(self, digests: DataFrame) -> DataFrame:
        """(digest, maybe) of the distinct digests by the filters alone: false means not live for certain."""
        shard = self._shard()
        state = self.filters().select("shard", "buckets", "cells")
        tagged = digests.select("digest").distinct().withColumn("shard", shard)

        def asked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter(int(right["buckets"].iloc[0]), right["cells"].iloc[0]) if len(right) else CuckooFilter(1)
            return pd.DataFrame({"digest": left["digest"], "maybe": [key_hash(d) in f for d in left["digest"]]})

        return tagged.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(asked, "digest string, maybe boolean")


def digest(text: str) -> F.Column:
    """SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "UTF-8"), 256)


def digested(documents: DataFrame) -> DataFrame:
    """(doc_id, digest) of documents (doc_id, text)."""
    return documents.select("doc_id", digest("text").alias("digest"))


def exact_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of documents (doc_id, text).

    Null texts equal empty ones; very long texts are read whole. Rows that repeat a doc_id count each, and are all
    kept if theirs is the smallest; a null doc_id is kept only where its whole group has none. Other columns are
    not read, whatever their names. An empty table gives no rows. All digests were inserted, so a probe could
    only say yes: the rows are joined with the keys that the filters let in.
    """
    spark = documents.sparkSession
    rows = written(digested(documents), "digests")
    index = CuckooIndex.empty(spark, rows.count()).insert(rows)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return index.lookup(rows).select("doc_id", "keep_id", F.col("copies").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
