"""Mixture-controlled packing of tokenised documents into fixed windows.

Every source is a queue of tokens. Round by round a queue's deficit grows by its share of a window and the
queue sends its deficit, in whole quanta; what is left is carried to the next round, and a sequence that a
round doesn't fill takes its rest from the next. A queue that is empty leaves its share to the others. The
running total that a queue has sent after r rounds is therefore a formula of r, the queue totals and the
target weights, so tasks place their documents without talking to each other: they need the totals by source
and where their own share of each queue starts.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 2048
#: A queue sends at least so many tokens at once, so that documents don't crumble.
QUANTUM = 256
END = 1
#: Queues that are served side by side; of more sources, the smallest share the last queue and are served in it in turn.
MAX_QUEUES = 1024
#: Rounds x queues that are looked at together.
BLOCK = 1 << 18
#: Pieces that a worker remembers at most.
CACHED = 800_000
#: Characters of texts whose pieces are looked up together; a longer text is alone.
TOGETHER = 1 << 21

#: Rows of (task, source, start) that are broadcast at most, some 100 bytes each.
BROADCAST_ROWS = 200_000

TOKENISED = "part int, doc_id long, source string, ids binary, n long, local_start long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Texts of these characters only (Latin, without what is neither letter, number, sign nor plain blank) are cut here.
_PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u012f\u0131-\u017f]*")
_LETTER, _NUMBER = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: What stands beside letters in a piece of its own.
_APART = f"([{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\\s{_LETTER}{_NUMBER}]+)"
#: By how this is cut it shows whether a tokenizer cuts as _cut does.
_PROBE = "it's we'll y've 'd'm'x x2 12 (naïve)--½½ é1ſß!?'re, µª…"


def _cut(texts: list[str]) -> pa.Array:
    """The list of each lower-cased plain text's pieces, with empty ones where blanks follow each other."""
    return pc.split_pattern(pc.replace_substring_regex(pa.array(texts, pa.large_string()), _APART, r" \1 "), " ")


def _unknown(new: set[str], known: dict[str, bytes], older: dict[str, bytes]) -> list[str]:
    """Those of new that aren't in older; the others move to known."""
    known.update((x, older[x]) for x in new if x in older)
    return [x for x in new if x not in older]


class WordIds:
    """Ids of texts by the pieces (words, digits, runs of signs) that the tokenizer cuts them into, as little-endian uint32 bytes.

    Texts are taken together: each different piece is looked up once and its ids are put wherever it stands. Pieces are
    encoded on their own, so the ids of those seen are remembered; new ones are encoded together, and each
    ends with a token that closes a word. The memory is bounded: when half of it is new, the older half goes, but
    for what was met since. Texts with other characters or with the tokenizer's own marks are encoded as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.pieces: dict[str, bytes] = {"": b""}
        self.older_pieces: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for pieces, which are lower-cased and composed already
        self.bare.normalizer = normalizers.Sequence([])
        if [_PROBE[a:b] for _, (a, b) in self.bare.pre_tokenizer.pre_tokenize_str(_PROBE)] == [x for x in _cut([_PROBE]).values.to_pylist() if x]:  # and cut already
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @property
    def words(self) -> dict[str, bytes]:
        """Words are pieces like others."""
        return self.pieces

    @property
    def older_words(self) -> dict[str, bytes]:
        return self.older_pieces

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[str]) -> bool:
        """False if the tokenizer cuts these pieces in another way."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
        if len(ends) != len(pieces):
            return False
        raw, at = ids.tobytes(), 0
        for piece, end in zip(pieces, ends.tolist()):
            self.pieces[piece] = raw[at:end]
            at = end
        return True

    def of(self, text: str) -> bytes:
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            if some and size + len(text) > TOGETHER:
                out += self._together(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        return out + self._together(some)

    def _together(self, texts: list[str]) -> list[bytes]:
        flat = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        plain = ["<|" not in f and bool(f.isascii() and f.isprintable() or _PLAIN.fullmatch(f)) for f in flat]
        found = self._plain([f.lower() for f, p in zip(flat, plain) if p])
        if found is None:
            return [self.ids(t).tobytes() for t in texts]
        found = iter(found)
        return [next(found) if p else self.ids(t).tobytes() for t, p in zip(texts, plain)]

    def _plain(self, texts: list[str]) -> list[bytes] | None:
        """Ids of lower-cased texts of plain characters, or None if the tokenizer cuts them in another way."""
        lists = _cut(texts)
        coded = lists.values.dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := set(pieces).difference(self.pieces):
            fresh = _unknown(new, self.pieces, self.older_pieces)
            if fresh and not self.learn(fresh):
                return None
        known = list(map(self.pieces.__getitem__, pieces))
        if len(self.pieces) > CACHED // 2:
            self.pieces, self.older_pieces = {"": b""}, self.pieces
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        codes = coded.indices.to_numpy()
        n = sizes[codes]
        ends = np.cumsum(n)
        ids = ids[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + n, n) + np.arange(n.sum())]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    """The memory of a worker, which its later tasks find filled."""
    return WordIds(path)


def tokenised(documents: DataFrame, path: str) -> DataFrame:
    """documents (doc_id, text, source) with their ids and the place in their task's share of the source's queue."""
    end = np.array([END], "<u4").tobytes()

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, starts, part = word_ids(path), {}, TaskContext.get().partitionId()
        for pdf in batches:
            pdf["ids"] = [x + end for x in words.each([t or "" for t in pdf.pop("text")])]
            pdf["n"] = pdf["ids"].str.len() // 4
            local = []
            for source, n in zip(pdf["source"], pdf["n"]):
                local.append(starts.get(source, 0))
                starts[source] = local[-1] + n
            yield pdf.assign(local_start=local, part=part)[["part", "doc_id", "source", "ids", "n", "local_start"]]

    return written(documents.select("doc_id", "text", "source").mapInPandas(encoded, TOKENISED), "tokens")


class Node:
    """Queues that are served side by side: how much each has sent after so many rounds.

    Queue q has `totals[q]` tokens and sends in proportion to `weights[q]` as long as it has any. At pace v it has
    sent weights[q] * v tokens; the pace after r rounds is where all queues together have sent r windows.
    """

    def __init__(self, totals: np.ndarray, weights: np.ndarray):
        self.totals, self.weights = totals.astype(np.int64), weights.astype(np.float64)
        self.whole = int(self.totals.sum())
        dry = self.totals / self.weights
        order = np.argsort(dry, kind="stable")
        self.paces = np.concatenate([[0.0], dry[order]])
        left = self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])])[:-1]
        self.reached = np.concatenate([[0.0], np.cumsum(np.maximum(left, 0) * np.diff(self.paces))])

    def _between(self, x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Linear between the points, never beyond the ends of a stretch, so that it never falls."""
        k = np.clip(np.searchsorted(xs, x, "right") - 1, 0, len(xs) - 2)
        step = xs[k + 1] - xs[k]
        share = np.divide(x - xs[k], step, out=np.ones_like(x), where=step > 0)
        return np.clip(ys[k] + share * (ys[k + 1] - ys[k]), ys[k], ys[k + 1])

    def last(self, window: int) -> int:
        return -(-self.whole // window)

    def sent(self, rounds: np.ndarray, window: int, quantum: int, queues: np.ndarray | None = None) -> np.ndarray:
        """Of each round a row with the tokens that each queue has sent, or of queues (as long as rounds) that queue's; all after the last round."""
        pace = self._between(np.maximum(rounds, 0).astype(np.float64) * window, self.reached, self.paces)
        if queues is None:
            pace, ended, totals, weights = pace[:, None], rounds[:, None] >= self.last(window), self.totals[None, :], self.weights[None, :]
        else:
            ended, totals, weights = rounds >= self.last(window), self.totals[queues], self.weights[queues]
        return np.where(ended, totals, np.minimum(np.floor(weights * pace / quantum).astype(np.int64) * quantum, totals))

    def round_of(self, queues: np.ndarray, goals: np.ndarray, window: int, quantum: int) -> np.ndarray:
        """The first round, counted from 1, after which each queue has sent its goal; the last one if none."""
        last = self.last(window)
        guess = np.ceil(self._between(goals / self.weights[queues], self.paces, self.reached) / window)
        rounds = np.clip(guess.astype(np.int64), 1, last)
        while (late := (rounds > 1) & (self.sent(rounds - 1, window, quantum, queues) >= goals)).any():  # what rounding of the guess left
            rounds = rounds - late
        while (early := (rounds < last) & (self.sent(rounds, window, quantum, queues) < goals)).any():
            rounds = rounds + early
        return rounds


def placed(node: Node, queue: np.ndarray, start: np.ndarray, n: np.ndarray, window: int, quantum: int) -> tuple[np.ndarray, ...]:
    """Pieces (item, offset in the item, length, place) of items: the n tokens at start of a queue.

    Looks only at the rounds in which an item's queue completes one of its quanta, in blocks of bounded size.
    """
    first = start // quantum + 1
    goals = np.where(n > 0, (start + n - 1) // quantum + 2 - first, 0)
    block, found = max(BLOCK // len(node.totals), 1), []
    ends = np.cumsum(goals)
    for low in range(0, int(ends[-1]) if len(ends) else 0, block):
        index = np.arange(low, min(low + block, int(ends[-1])))
        item = np.searchsorted(ends, index, "right")
        goal = (first[item] + index - (ends[item] - goals[item])) * quantum
        rounds = node.round_of(queue[item], goal, window, quantum)
        fresh = np.concatenate([[True], (item[1:] != item[:-1]) | (rounds[1:] != rounds[:-1])])
        item, rounds = item[fresh], rounds[fresh]
        known = np.unique(np.concatenate([rounds - 1, rounds]))
        upto = node.sent(known, window, quantum)
        behind = np.cumsum(upto, 1) - upto
        was, now, q = np.searchsorted(known, rounds - 1), np.searchsorted(known, rounds), queue[item]
        a0, b0 = upto[was, q], upto[now, q]
        a, b = np.maximum(start[item], a0), np.minimum(start[item] + n[item], b0)
        at = upto.sum(1)[was] + behind[now, q] - behind[was, q] + a - a0
        some = a < b
        found.append((item[some], (a - start[item])[some], (b - a)[some], at[some]))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _joined(item: np.ndarray, offset: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces in order of item and offset, with those made one that follow each other in both; a block may repeat the end of the one before."""
    order = np.lexsort((offset, item))
    item, offset, length, place = item[order], offset[order], length[order], place[order]
    if not len(item):
        return item, offset, length, place
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (offset[1:] != offset[:-1]) | (place[1:] != place[:-1])])
    item, offset, length, place = item[new], offset[new], length[new], place[new]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (offset[:-1] + length[:-1] != offset[1:]) | (place[:-1] + length[:-1] != place[1:])])
    starts = np.flatnonzero(new)
    return item[new], offset[new], np.add.reduceat(length, starts), place[new]


def windowed(item: np.ndarray, offset: np.ndarray, length: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces (item, offset, length, sequence, offset there), cut where a sequence ends."""
    cuts = np.where(length > 0, (place + length - 1) // window - place // window + 1, 0)
    of = np.repeat(np.arange(len(item)), cuts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = np.where(k == 0, place[of], (place[of] // window + k) * window)
    end = np.minimum(place[of] + length[of], (begin // window + 1) * window)
    return item[of], offset[of] + begin - place[of], end - begin, begin // window, begin % window


class Queues:
    """Queues of queues: of more than `most` sources, the smallest share the last queue, in which they take turns in the same way.

    A node deals to `most` queues at most. Sources are known by their rank by size; those of a shared queue are
    dealt over queues by rank, so the depth grows with the logarithm of their number.
    """

    def __init__(self, sizes: np.ndarray, weights: np.ndarray, most: int):
        self.sizes, self.weights, self.most = sizes, weights, most
        self.nodes: dict[tuple[int, ...], Node] = {}

    def _node(self, key: tuple[int, ...], groups: list[slice]) -> Node:
        if key not in self.nodes:
            self.nodes[key] = Node(np.array([self.sizes[g].sum() for g in groups]), np.array([self.weights[g].sum() for g in groups]))
        return self.nodes[key]

    def path(self, rank: int) -> list[tuple[int, tuple[int, ...]]]:
        """(queue, key of its node) from the root to the source."""
        size, most = len(self.sizes), self.most
        if size <= most:
            self._node((), [slice(k, k + 1) for k in range(size)])
            return [(rank, ())]
        own = most - 1
        self._node((), [*(slice(k, k + 1) for k in range(own)), slice(own, None)])
        out = [(min(rank, own), ())]
        if rank < own:
            return out
        k, step, at, key = rank - own, 1, 0, (0,)
        while True:  # the members of a node: every step-th of the shared sources, from `at`
            members = -(-(size - own - at) // step)
            split = most if members > most else members
            queue = (k - at) // step % split
            if key not in self.nodes:
                self._node(key, [slice(own + at + q * step, None, step * split) for q in range(split)])
            out.append((queue, key))
            if members <= most:
                return out
            at, step, key = at + queue * step, step * most, (*key, queue)

    def placed(self, ranks: np.ndarray, start: np.ndarray, n: np.ndarray, window: int, quantum: int) -> tuple[np.ndarray, ...]:
        """Pieces (item, offset, length, sequence, offset there) of items of sources, by rank: what a node has placed is where its own queue takes it from."""
        paths, alike, found = {r: self.path(r) for r in np.unique(ranks).tolist()}, {}, []
        for i, r in enumerate(ranks.tolist()):
            alike.setdefault(tuple(key for _, key in paths[r]), []).append(i)
        for path, mine in alike.items():
            mine = np.array(mine, np.int64)
            item, offset, length, place = mine, np.zeros(len(mine), np.int64), n[mine], start[mine]
            for depth in range(len(path) - 1, -1, -1):
                queue = np.array([paths[r][depth][0] for r in ranks[item].tolist()], np.int64)
                of, o, k, p = placed(self.nodes[path[depth]], queue, place, length, window, quantum)
                item, offset, length, place = _joined(item[of], offset[of] + o, k, p)
            found.append(windowed(item, offset, length, place, window))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def packed(documents: DataFrame, path: str, window: int = WINDOW, quantum: int = QUANTUM, weights: dict[str | None, float] | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    weights: the target proportions of sources, 1 for those that it doesn't name; without it, sources go in
    proportion to their tokens. Each window holds each source's target share to within a quantum and what its
    deficit carries; sources that run out leave their share to the others. Null and empty texts are one END
    token; null is a source of its own; rows with one doc_id are packed each on their own; very long texts are
    cut like others. Other columns are not read, whatever their names. Only the last sequence may be short. An
    empty table gives no rows.
    """
    tokens = tokenised(documents, path)
    totals = written(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "totals")
    by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = totals.groupBy("source").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "source")) - 1)
    ranked = written(ranked, "queues")
    starts = totals.withColumn("base", F.coalesce(F.sum("n").over(by_source), F.lit(0))).alias("t").join(
        ranked.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source"))).select("t.source", "t.part", "r.rank", "base")
    sizes, targets = [], []
    for r in ranked.orderBy("rank").select("source", "n").toLocalIterator():  # two numbers for each source
        sizes.append(r["n"])
        targets.append(r["n"] if weights is None else max(float(weights.get(r["source"], 1)), 1e-9))
    sizes, targets = np.array(sizes, np.int64), np.array(targets, np.float64)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queues = Queues(sizes, targets, MAX_QUEUES)
        for pdf in batches:
            item, a, k, sequence, offset = queues.placed(*[pdf[c].to_numpy(np.int64) for c in ("rank", "start", "n")], window, quantum)
            views = [memoryview(x) for x in pdf["ids"]]
            crc = [zlib.crc32(views[i][4 * x : 4 * (x + y)]) for i, x, y in zip(item.tolist(), a.tolist(), k.tolist())]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").to_numpy()[item], "start": a, "length": k, "ids_crc32": crc, "doc_tokens": pdf["n"].to_numpy()[item], "sequence_id": sequence, "offset": offset})

    # A row for each task and source; if few, they go to the tokens, else both are shuffled.
    starts = F.broadcast(starts) if totals.count() <= BROADCAST_ROWS else starts
    whole = tokens.alias("k").join(starts.alias("s"), F.col("k.source").eqNullSafe(F.col("s.source")) & (F.col("k.part") == F.col("s.part")))
    return whole.select("k.doc_id", "k.ids", "k.n", "s.rank", (F.col("s.base") + F.col("k.local_start")).alias("start")).mapInPandas(pieces, PIECES)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary())
