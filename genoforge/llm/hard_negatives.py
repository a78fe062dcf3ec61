"""Hard-negative mining by branch and bound over ball trees.

Each partition of the vectors is a tree of balls. A ball's centre and radius bound its inner products with an anchor
from above and below, so a node is passed over if they lie outside the window of scores that is asked for, or
strictly beneath the anchor's current k-th. Anchors meet a tree in batches: a node's bounds are taken for all
anchors that still need it. First each anchor's positives are found, then the negatives in each positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import matrix, scaled, usable

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components from here on count as not finite: products must fit a long.
LIMIT = 2.0**20
LEAF = 64
#: Components of a tree at most, on average; few vectors still make a tree for each task, of so many vectors at least.
TREE_ENTRIES, LEAST_ROWS = 4_000_000, 512
NONE = np.iinfo(np.int64).min


class BallTree:
    """Vectors in an order in which each node is a stretch; nodes hold centre, radius, and their two halves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        order, points = np.arange(len(ids)), x.astype(float)
        if len(ids):
            self._build(order, points, 0, len(ids))
        self.ids, self.labels, self.x, self.points = ids[order], labels[order], x[order], points[order]
        self.largest = int(np.abs(x).max(initial=0))

    def _build(self, order: np.ndarray, points: np.ndarray, a: int, b: int) -> int:
        own = points[order[a:b]]
        centre = own.mean(0)
        off = ((own - centre) ** 2).sum(1)
        at = len(self.nodes)
        self.nodes.append((a, b, centre, float(np.sqrt(off.max())), -1, -1))
        if b - a > LEAF:
            one = own[off.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            order[a:b] = order[a:b][np.argsort(own @ (one - other), kind="stable")]
            middle = (a + b) // 2
            left = self._build(order, points, a, middle)
            self.nodes[at] = (*self.nodes[at][:4], left, self._build(order, points, middle, b))
        return at


class Search:
    """A batch of anchors in one tree: for each anchor and window the k best vectors so far, by score, then id."""

    def __init__(self, tree: BallTree, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.tree, self.ids, self.labels, self.low, self.high, self.k, self.same = tree, ids, labels, low, high, k, same
        exact = tree.largest * int(np.abs(x).max(initial=0)) * x.shape[1] < 1 << 53
        self.floats = x.astype(float)
        self.x, self.rows = (self.floats, tree.points) if exact else (x, tree.x)
        self.norms = np.sqrt((self.floats**2).sum(1))
        self.scores = np.full((*low.shape, k), NONE)
        self.found = np.zeros((*low.shape, k), np.int64)
        if tree.nodes and len(ids):
            self.visit(0, np.arange(len(ids)))

    def visit(self, node: int, who: np.ndarray) -> None:
        a, b, centre, radius, left, right = self.tree.nodes[node]
        middle, reach = self.floats[who] @ centre, self.norms[who] * radius
        slack = 1 + 1e-9 * (np.abs(middle) + reach)  # of rounding
        top, bottom = (middle + reach + slack)[:, None], (middle - reach - slack)[:, None]
        wanted = (top >= self.low[who]) & (bottom <= self.high[who]) & (top >= self.scores[who, :, -1])
        who = who[wanted.any(1)]
        if not len(who):
            return
        if left < 0:
            self.leaf(a, b, who)
            return
        first = (self.floats[who] @ (self.tree.nodes[left][2] - self.tree.nodes[right][2])).mean() >= 0
        for child in (left, right) if first else (right, left):
            self.visit(child, who)

    def leaf(self, a: int, b: int, who: np.ndarray) -> None:
        score = (self.x[who] @ self.rows[a:b].T).astype(np.int64)
        fits = (self.labels[who][:, None] == self.tree.labels[a:b]) == self.same
        fits &= self.ids[who][:, None] != self.tree.ids[a:b]
        for j in range(self.low.shape[1]):
            own = fits & (score >= self.low[who, j][:, None]) & (score <= self.high[who, j][:, None]) & (score >= self.scores[who, j, -1][:, None])
            some = own.any(1)
            if not some.any():
                continue
            w = who[some]
            s = np.concatenate([self.scores[w, j], np.where(own[some], score[some], NONE)], 1)
            i = np.concatenate([self.found[w, j], np.broadcast_to(self.tree.ids[a:b], (len(w), b - a))], 1)
            best = np.lexsort((i, ~s), axis=1)[:, : self.k]
            self.scores[w, j], self.found[w, j] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)


def searched(rows: DataFrame, anchors: DataFrame, trees: int, d: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): what each tree has for each anchor (vec_id, label, x, windows).

    Vectors and the anchors that meet them travel to the tree's task, vectors first; a task holds one tree and a batch
    of anchors. Of vectors that share a vec_id, which all lie in one tree, that with the smallest label, then smallest
    components stays.
    """
    kinds = "array<struct<id:long,score:long,low:long,high:long>>"
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int").alias("tree"), F.lit(0).alias("kind"), "vec_id", "label", "x", F.lit(None).cast(kinds).alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).alias("kind"), "vec_id", "label", "x", "windows")
    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]

    def grown(held: list[tuple]) -> BallTree:
        ids, labels, x = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((*x.T[::-1], labels, ids))
        order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
        return BallTree(ids[order], labels[order], x[order])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tree = None, [], None
        for batch in batches:
            where, kind = batch["tree"].to_numpy(), batch["kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(where * 2 + kind)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if where[a] != at:
                    at, held, tree = where[a], [], None
                ids, labels, x = part["vec_id"].to_numpy(), part["label"].to_numpy(), matrix(part["x"], d)
                if not kind[a]:
                    held.append((ids, labels, x))
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    tree, held = grown(held), []
                sizes = np.diff(part["windows"].offsets.to_numpy())
                there = np.arange(sizes.max(initial=0)) < sizes[:, None]
                fields = {name: np.full(there.shape, fill, np.int64) for name, fill in (("id", 0), ("score", 0), ("low", 1), ("high", 0))}
                for name, values in fields.items():
                    values[there] = part["windows"].flatten().field(name).to_numpy()
                s = Search(tree, ids, labels, x, fields["low"], fields["high"], k, same)
                q, j, r = np.nonzero(s.scores != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[q], fields["id"][q, j], fields["score"][q, j], s.found[q, j, r], s.scores[q, j, r])], names=names)

    both = own.unionByName(asked).repartition(trees, "tree").sortWithinPartitions("tree", "kind")
    return both.mapInArrow(tasks, ", ".join(f"{name} long" for name in names))


def best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best of all trees, with their rank; Spark keeps k a task before it shuffles."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def window(low: Column, high: Column, positive: Column, score: Column) -> Column:
    return F.struct(positive.alias("id"), score.alias("score"), low.alias("low"), high.alias("high"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    Rows without vec_id, label or vector, or with a component that is null, not finite or 2**20 and more, take no part;
    vectors shorter than the longest are continued with zeros. vec_id is the key: of rows that share one, that with
    the smallest label, then the smallest components stays. Equal scores come by vec_id. Anchors without positives,
    and positives without a negative in their window (all those of negative score), give no rows; nor does an empty
    table. Other columns aren't read.
    """
    label = F.col("label").cast("long")
    rows = embeddings.where(usable("embedding", LIMIT) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), scaled("embedding", SCALE).alias("x"))
    n, d = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = max(1, -(-n * d // TREE_ENTRIES), min(tasks, -(-n // LEAST_ROWS)))
    own = rows.where("vec_id % 100 = 0").groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    anchors = written(own, "anchors")
    every = window(F.lit(NONE + 1), F.lit((1 << 63) - 1), F.lit(0).cast("long"), F.lit(0).cast("long"))
    near = best(searched(rows, anchors.withColumn("windows", F.array(every)), trees, d, POSITIVES, True), POSITIVES, "anchor_id")
    low, high = F.expr(f"({LOW} * score + 99) div 100"), F.expr(f"{HIGH} * score div 100")
    windows = near.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(window(low, high, F.col("id"), F.col("score"))).alias("windows"))
    asked = written(anchors.join(windows, "vec_id"), "asked")
    found = best(searched(rows, asked, trees, d, NEGATIVES, False), NEGATIVES, "anchor_id", "positive_id")
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
  list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10"""
