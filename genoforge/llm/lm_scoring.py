"""Language-model scores from a log-frequency Bloom filter.

The filter holds an n-gram's count on a logarithmic scale: one that was seen c times is in it with each of the levels
1 to 1 + floor(log2 c). Membership of one level after another, until one is missing, gives the count back up to a
factor of two. The filter is cut by hash into slices that tasks build and workers hold as one broadcast; a larger
one stays a table whose slices answer the n-grams of each chunk of texts. Counts and probes cover whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ORDER = 3
FOLDS, HELD_OUT = 7, 2
#: Weight of the shorter history against one occurrence of the longer one.
PRIOR = 32.0
#: Bits that an n-gram sets at each level, so about one stranger in 2**PROBES passes a level, and room for each of them.
PROBES, ROOM = 4, 1.75
#: N-grams are told apart by so many bits of their hashes; slices are ranges of these.
BITS = 52
#: Occurrences of n-grams in one slice, on average and before repeats are merged.
SLICE = 4_000_000
#: Bytes of filter that are broadcast at most; a larger filter is probed where its slices lie.
BROADCAST = 160_000_000
#: Words that occur once in HOT tokens at least, so HOT words at most, go to all workers if they have no more than HOT_BYTES; others are joined.
HOT, HOT_BYTES = 500_000, 64
#: N-grams that a task gathers before it packs them, words before it sends their counts, and characters of a chunk.
GATHERED, WORDS, CHUNK = 3_000_000, 300_000, 2_000_000
END = b""

_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


_BEGIN_HASH, _END_HASH = np.uint64(1), np.uint64(2)


class Vocabulary:
    """Frequent words by number, with their hashes and log10 probabilities; other words are hashed one by one."""

    def __init__(self, words: list[bytes], logs: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.logs = logs
        self.hashes = np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(0))

    def read(self, flat: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's number or -1, each word's hash, and the places of the words without number."""
        at = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        cold, h = np.flatnonzero(at < 0), self.hashes[at]
        h[cold] = np.fromiter((xxhash.xxh3_64_intdigest(flat[i]) for i in cold.tolist()), np.uint64, len(cold))
        return at, h, cold


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(29))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class Grams:
    """Of several texts in a row, each between its begin and end: the n-gram of each order that ends at each token."""

    def __init__(self, texts: list[list[bytes]], order: int, vocabulary: Vocabulary | None = None):
        sizes = np.array([len(w) + 2 for w in texts], np.int64)
        ends = np.cumsum(sizes)
        self.text = np.repeat(np.arange(len(texts)), sizes)
        self.place = np.arange(len(self.text)) - np.repeat(ends - sizes, sizes)
        self.flat = list(chain.from_iterable(texts))
        self.at, words, self.cold = (vocabulary or Vocabulary([], np.zeros(0))).read(self.flat)
        h = np.empty(len(self.text), np.uint64)
        self.inner = np.ones(len(h), bool)
        self.inner[ends - sizes] = self.inner[ends - 1] = False
        h[ends - sizes], h[ends - 1], h[self.inner] = _BEGIN_HASH, _END_HASH, words
        self.words = words
        self.hashes: list[np.ndarray] = []
        gram = np.zeros(len(h), np.uint64)
        for m in range(1, order + 1):
            gram = mixed(np.concatenate([gram[:1], gram[:-1]]) * _ODD + h + np.uint64(m))
            self.hashes.append(gram >> np.uint64(64 - BITS))

    def all(self) -> np.ndarray:
        return np.concatenate([h[self.place >= m] for m, h in enumerate(self.hashes)]) if len(self.text) else np.zeros(0, np.uint64)


def packed(a: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """Rising numbers as differences, byte by byte."""
    return press.compress(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def with_counts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rising hashes with their counts in the bits that are left; a count that is too large takes several numbers."""
    most = (1 << (64 - BITS)) - 1
    times = (counts - 1) // most + 1
    if times.max(initial=1) == 1:
        return h << np.uint64(64 - BITS) | counts.astype(np.uint64)
    part = np.full(int(times.sum()), most)
    part[np.cumsum(times) - 1] = counts - (times - 1) * most
    return np.repeat(h, times) << np.uint64(64 - BITS) | part.astype(np.uint64)


def counted_again(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes and their counts, of what with_counts gave in several parts."""
    numbers = np.sort(numbers)
    h = numbers >> np.uint64(64 - BITS)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat((numbers & np.uint64((1 << (64 - BITS)) - 1)).astype(np.int64), first)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return ((h >> np.uint64(BITS - 32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def cuts(rising: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of rising hashes: slices are equal ranges."""
    of = slice_of(rising, slices)
    if not len(of):
        return []
    at = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    return [(int(of[a]), a, b) for a, b in zip(at, at[1:])]


def places(h: np.ndarray, level: int, size: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each n-gram at a level: one of `size` words, and the bits in it."""
    x = mixed((h + np.uint64(level << BITS)) * _ODD)
    y, mask = mixed(x + _ODD), np.zeros(len(h), np.uint64)
    for k in range(probes):
        mask |= np.uint64(1) << (y >> np.uint64(6 * (k % 10)) & np.uint64(63))
        y = mixed(y * _MIX) if k % 10 == 9 else y
    return (x >> np.uint64(32)) * size >> np.uint64(32), mask


class LogBloom:
    """Slices of the filter in a row, in words of 64 bits; the bits of an n-gram's level lie in one word."""

    def __init__(self, bits: np.ndarray, probes: int = PROBES, sizes: np.ndarray | None = None):
        self.bits, self.probes = bits.view(np.uint64), probes
        self.sizes = np.array([len(self.bits)] if sizes is None else sizes, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @staticmethod
    def of(h: np.ndarray, counts: np.ndarray, probes: int = PROBES, room: float = ROOM) -> LogBloom:
        levels = np.frexp(counts.astype(float))[1]  # 1 + floor(log2)
        bits = np.zeros(max(1, int(levels.sum() * probes * room) // 64 + 1), np.uint64)
        for level in range(1, int(levels.max(initial=0)) + 1):
            np.bitwise_or.at(bits, *places(h[levels >= level], level, np.uint64(len(bits)), probes))
        return LogBloom(bits, probes)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """How many levels of each n-gram are in the filter, one after another."""
        of = slice_of(h, len(self.sizes))
        out, alive, level = np.zeros(len(h), np.uint8), np.flatnonzero(self.sizes[of]), 0
        size, start = self.sizes[of[alive]], self.starts[of[alive]]
        while len(alive):
            level += 1
            at, mask = places(h[alive], level, size, self.probes)
            own = np.flatnonzero(self.bits[start + at] & mask == mask)
            alive, size, start = alive[own], size[own], start[own]
            out[alive] = level
        return out


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all training texts; the end of a text is the empty word. Tasks add up before anything is shuffled."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                found.update(words(text))
                found[END] += 1
                if len(found) > WORDS:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found = Counter()
        yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    return documents.where(~held_out()).select("text").mapInPandas(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def filter_slices(documents: DataFrame, known: Broadcast, slices: int, order: int, probes: int, room: float) -> DataFrame:
    """(slice, bits): the filter over all training texts. A task packs what it has of each slice; a slice's task adds up."""

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press, held, n = zstandard.ZstdCompressor(level=1), [], 0

        def sent() -> pd.DataFrame:
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pd.DataFrame([(s, packed(with_counts(h[a:b], c[a:b]), press)) for s, a, b in cuts(h, slices)], columns=["slice", "grams"])

        for pdf in batches:
            for a in range(0, len(pdf), 100):
                held.append(Grams([words(t) for t in pdf["text"].iloc[a : a + 100]], order, known.value).all())
                n += len(held[-1])
                if n > GATHERED:
                    yield sent()
                    held, n = [], 0
        yield sent()

    def built(s: int, own: list[bytes]) -> pd.DataFrame:
        bloom = LogBloom.of(*counted_again(np.concatenate([unpacked(x) for x in own])), probes, room)
        return pd.DataFrame([(s, bloom.bits.tobytes())], columns=["slice", "bits"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for pdf in batches:
            for s, grams in zip(pdf["slice"], pdf["grams"]):
                if s != at and held:
                    yield built(at, held)
                    held = []
                at = s
                held.append(grams)
        if held:
            yield built(at, held)

    parts = documents.where(~held_out()).select("text").mapInPandas(gathered, "slice long, grams binary")
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "slice").sortWithinPartitions("slice").mapInPandas(merged, "slice long, bits binary")


#: The smallest and the largest count with so many levels.
LEAST = np.concatenate([[0], np.exp2(np.arange(64))])
MOST = np.exp2(np.arange(65)) - 1


def before(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a[:1], a[:-1]])


def probabilities(g: Grams, levels: list[np.ndarray], tokens: float, kinds: int, prior: float) -> np.ndarray:
    """Of each token after what stands before it; 1 at the begin of a text.

    A count is the least, a history's the most that its levels allow, so a history's probabilities never add up to more
    than one, and an n-gram is seen no more often than its parts.
    """
    for m in range(1, len(levels)):
        levels[m] = np.minimum(levels[m], np.minimum(levels[m - 1], before(levels[m - 1])))
    p = (LEAST[levels[0]] + 1) / (tokens + kinds + 1)
    for m in range(1, len(levels)):
        history = MOST[before(levels[m - 1])]
        p = np.where((g.place >= m) & (history > 0), (LEAST[levels[m]] + prior * p) / (history + prior), p)
    return np.where(g.place > 0, p, 1)


def chunks(documents: DataFrame) -> DataFrame:
    """(chunk, doc_ids, held, texts): rows in chunks of CHUNK characters; a longer text is a chunk alone."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, size, names = TaskContext.get().partitionId() << 32, [], 0, ["chunk", "doc_ids", "held", "texts"]
        for pdf in batches:
            for row in zip(pdf["doc_id"].astype("Int64"), pdf["held_out"], pdf["text"]):
                if held and size + len(row[2] or "") > CHUNK:
                    yield pd.DataFrame([(at, *map(list, zip(*held)))], columns=names)
                    at, held, size = at + 1, [], 0
                held.append((None if row[0] is pd.NA else int(row[0]), bool(row[1]), row[2]))
                size += len(row[2] or "")
        if held:
            yield pd.DataFrame([(at, *map(list, zip(*held)))], columns=names)

    return documents.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(cut, "chunk long, doc_ids array<long>, held array<boolean>, texts array<string>")


def asked(parts: DataFrame, bits: DataFrame, slices: int, order: int, probes: int) -> DataFrame:
    """(chunk, slice, levels): the levels of each chunk's different n-grams, answered where the slices of the filter lie."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            for chunk, texts in zip(pdf["chunk"], pdf["texts"]):
                h = np.unique(Grams([words(t) for t in texts], order).all())
                yield pd.DataFrame([(chunk, s, packed(h[a:b], press)) for s, a, b in cuts(h, slices)], columns=["chunk", "slice", "data"])

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press, at, own = zstandard.ZstdCompressor(level=1), None, LogBloom(np.zeros(0, np.uint8))
        for pdf in batches:
            out = []
            for chunk, s, data in zip(pdf["chunk"], pdf["slice"], pdf["data"]):
                if s != at:
                    at, own = s, LogBloom(np.zeros(0, np.uint8))
                if chunk < 0:
                    own = LogBloom(np.frombuffer(data, np.uint8), probes)
                else:
                    out.append((chunk, s, press.compress(own.levels(unpacked(data)).tobytes())))
            yield pd.DataFrame(out, columns=["chunk", "slice", "levels"])

    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = bits.select(F.lit(-1).cast("long").alias("chunk"), "slice", F.col("bits").alias("data")).unionByName(parts.select("chunk", "texts").mapInPandas(sent, "chunk long, slice long, data binary"))
    return both.repartition(tasks, "slice").sortWithinPartitions("slice", "chunk").mapInPandas(answered, "chunk long, slice long, levels binary")


def scored(documents: DataFrame, order: int = ORDER, prior: float = PRIOR, probes: int = PROBES, room: float = ROOM) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of documents (doc_id, text).

    score: the model's log10 probability of the text's words and its end. Null texts are empty ones, whose end is their
    only token; texts are read whole, however long. Rows without doc_id are learned from; rows that repeat a doc_id or a
    text count and return as often as they are there. With nothing to learn from every score is 0 and nothing
    is known. An empty table gives no rows; other columns aren't read, whatever their names.
    """
    spark = documents.sparkSession
    counts = written(word_counts(documents), "words")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("kinds"),
                        F.coalesce(F.sum(F.expr("shiftleft(1L, length(bin(n)) - 1)")), F.lit(0)).alias("least")).first()
    n, v = totals["tokens"], totals["kinds"]
    hot = counts.where((F.col("n") * HOT >= n) & (F.octet_length("word") <= HOT_BYTES)).toPandas()  # HOT words at most
    logs = np.log10((hot["n"].to_numpy(np.int64) + 1) / (n + v + 1))
    known = spark.sparkContext.broadcast(Vocabulary([bytes(w) for w in hot["word"]], logs))
    slices = max(1, -(-n * order // SLICE))
    bits = written(filter_slices(documents, known, slices, order, probes, room), "filter")
    size = bits.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]

    ending = known.value.index.get(END, -1)

    def rows(ids: list, held: list, g: Grams, levels: list[np.ndarray]) -> pd.DataFrame:
        score = np.bincount(g.text, np.log10(probabilities(g, levels, totals["least"], v, prior)), len(ids))
        logs, text = known.value.logs, g.text[g.inner]
        size, hot = np.bincount(text, minlength=len(ids)), g.at >= 0
        base, n_hot = np.bincount(text[hot], logs[g.at[hot]], len(ids)), np.bincount(text[hot], minlength=len(ids))
        # Words of one text are told apart by the bits of their hashes that the text's number leaves.
        bits = np.uint64(max(len(ids), 1).bit_length())
        key = text[g.cold].astype(np.uint64) << (np.uint64(64) - bits) | g.words[g.cold] >> bits
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        ends = np.searchsorted(text[g.cold][first], np.arange(len(ids) + 1))
        strange, times = [g.flat[i] for i in g.cold[first].tolist()], times.tolist()
        out = []
        for i, (doc_id, out_of, a, b) in enumerate(zip(ids, held, ends.tolist(), ends[1:].tolist())):
            end = ([], []) if ending >= 0 else ([END], [1])
            out.append((doc_id, out_of, int(size[i]) + 1, int(n_hot[i]) + (ending >= 0), float(base[i]) + (float(logs[ending]) if ending >= 0 else 0.0), float(score[i]), strange[a:b] + end[0], times[a:b] + end[1]))
        pdf = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "hot", "base", "score", "cold", "times"])
        return pdf.assign(doc_id=pdf["doc_id"].astype("Int64"))

    kinds = "doc_id long, held_out boolean, n_tokens long, hot long, base double, score double, cold array<binary>, times array<long>"
    if size <= BROADCAST:
        sizes, held = np.zeros(slices, np.uint64), np.zeros(size, np.uint8)
        at = 0
        for r in bits.orderBy("slice").toLocalIterator():
            sizes[r["slice"]] = len(r["bits"]) // 8
            held[at : at + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
            at += len(r["bits"])
        sent = spark.sparkContext.broadcast((held, sizes))
        del held

        def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bloom = LogBloom(sent.value[0], probes, sent.value[1])
            for pdf in batches:
                for a in range(0, len(pdf), 200):
                    part = pdf.iloc[a : a + 200]
                    g = Grams([words(t) for t in part["text"]], order, known.value)
                    yield rows(part["doc_id"].astype("Int64").tolist(), part["held_out"].tolist(), g, sought(g, bloom))

        one = documents.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(here, kinds)
    else:
        parts = written(chunks(documents), "chunks")
        answers = written(asked(parts, bits, slices, order, probes).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("slice", "levels"))).alias("answers")), "answers")

        def there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for ids, held, texts, found in zip(pdf["doc_ids"], pdf["held"], pdf["texts"], pdf["answers"]):
                    g = Grams([words(t) for t in texts], order, known.value)
                    back = np.unique(g.all(), return_inverse=True)[1]
                    levels = np.concatenate([np.frombuffer(zstandard.decompress(x), np.uint8) for x in found])
                    yield rows([None if pd.isna(i) else int(i) for i in ids], list(held), g, spread(g, levels[back]))

        one = parts.join(answers, "chunk").select("doc_ids", "held", "texts", F.col("answers.levels").alias("answers")).mapInPandas(there, kinds)
    one = written(one.withColumn("row", F.monotonically_increasing_id()), "scored")
    cold = one.select("row", F.explode(F.arrays_zip("cold", "times")).alias("c")).select("row", F.col("c.cold").alias("word"), F.col("c.times").alias("times"))
    joined = cold.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("rest"))
    both = one.drop("cold", "times").join(joined, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("hot") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                       (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score")


def spread(g: Grams, levels: np.ndarray) -> list[np.ndarray]:
    """What was found of all n-grams in a row, as an array for each order; 0 where a text's begin is too near."""
    out, at = [], 0
    for m in range(len(g.hashes)):
        there = g.place >= m
        own = np.zeros(len(g.text), np.uint8)
        own[there] = levels[at : at + int(there.sum())]
        out.append(own)
        at += int(there.sum())
    return out


def sought(g: Grams, bloom: LogBloom) -> list[np.ndarray]:
    """The levels of all n-grams, an array for each order. One is only sought if its parts are there."""
    kinds, back = np.unique(g.hashes[0], return_inverse=True)
    out = [bloom.levels(kinds)[back]]
    for m in range(1, len(g.hashes)):
        may = np.flatnonzero((out[-1] > 0) & (before(out[-1]) > 0) & (g.place >= m))
        own = np.zeros(len(g.text), np.uint8)
        own[may] = bloom.levels(g.hashes[m][may])
        out.append(own)
    return out


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
