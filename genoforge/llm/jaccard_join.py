"""N-gram Jaccard self-join by a token-group matrix, exact at its threshold.

The tokens of a set are the parts into which its shingles are dealt: sets that differ in at most K shingles
agree in more than `spare` of K + 1 + spare parts. Documents are partitioned into groups: each goes home to the
document with the most company among those that it shares a token with. The matrix, rows (token, group, members
that have it), is each group's token union. A query meets the groups that its tokens name, and a group is
opened only if its union holds as many of the query's tokens as any link needs.

In an opened group everything is known by its difference from the group's base. Who is close enough to the
base is linked by it; of the others, the union of the members' differences bounds the overlap once more, and
pairs are compared only where the rarest tokens of their differences meet, so copies that stay near their
base are never paired with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, discarded, table, written

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Ratio of the sizes at a size class's ends.
CLASS_RATIO = 1.5
#: Turns in which tokens are matched, so that only so large a share of them is shuffled at once.
SLICES = 3
#: A token's lowest bits hold its size class.
CLASSES = 128


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


_hashes = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


def shingles(text: str | bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, with A-Z lower-cased; shorter texts are one shingle."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _ODD + w[k : len(w) - width + 1 + k]
    return np.unique(_mixed(h))


def most_apart(total: int, num: int, den: int) -> int:
    """Shingles in which linked sets may differ at most, if their sizes sum to total."""
    return total * (den - num) // (den + num)


@lru_cache(maxsize=8)
def size_classes(num: int, den: int) -> list[int]:
    """Lower bounds of size classes; a linked pair lies in one class or in two neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * den // num), int(bounds[-1] * CLASS_RATIO)))
    return bounds


def slack(bound: int) -> tuple[int, int, int]:
    """(spare, hot, need) of a size class whose linked sets differ in `bound` shingles at most.

    Sets are dealt to bound + 1 + spare parts. Linked sets name hot + need parts alike; each may leave out its
    `hot` most frequent ones, and `need` of them are still the same.
    """
    spare = 2 + bound // 7
    alike = spare // 2
    return spare, alike // 2, alike - alike // 2


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the set's parts, for its size class and, where larger partners may lie there, the next.

    Sets that differ in d shingles agree in all but d parts at least, and a set's size bounds d for all of its
    partners. So it may leave out its smallest parts, empty ones and those of a shingle or two that anything may
    share, as long as hot + need of those that agree are left: equal parts have equal sizes, so of two sets one
    leaves out all that the other does. If the parts of one size are too many, it leaves out no such part.
    """
    n, bounds, out = len(tokens), size_classes(num, den), []
    if not n:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(bounds, n, "right")) - 1
    for c in (own, own + 1):
        if c > own and num * bounds[c] > den * n:
            break
        bound = most_apart(2 * (bounds[c + 1] - 1), num, den)
        if bound:  # else only equal sets can be linked
            spare, hot, need = slack(bound)
            parts = bound + 1 + spare
            agree = parts - most_apart(n + min(bounds[c + 1] - 1, n * den // num), num, den)
            part = (tokens % np.uint64(parts)).astype(np.int64)
            order, count = np.argsort(part, kind="stable"), np.bincount(part, minlength=parts)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(tokens[order] * _ODD), dtype=np.uint64)])
            ends = np.cumsum(count)
            named = _mixed((sums[ends] - sums[ends - count]) * _ODD + np.arange(parts, dtype=np.uint64) * _MIX + np.uint64(c))
            named = named // np.uint64(CLASSES) * np.uint64(CLASSES) + np.uint64(c)
            out.append(named[count > np.searchsorted(np.cumsum(np.bincount(count)), agree - hot - need, "right") - 1])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _of_class(token: F.Column, num: int, den: int, which: int) -> F.Column:
    """An entry of slack() for the token's size class."""
    bounds = size_classes(num, den)
    entries = [slack(most_apart(2 * (bounds[c + 1] - 1), num, den))[which] for c in range(len(bounds) - 1)]
    return F.get(F.array(*[F.lit(x) for x in entries]), F.pmod(token, F.lit(CLASSES)).cast("int"))


def shingled(documents: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, set_key, tokens), a row for each row of documents (doc_id, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                s = shingles(text, width)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, signatures(s, num, den).view(np.int64)))
            n, key, tokens = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": n, "set_key": key, "tokens": tokens})

    return documents.select("doc_id", "text").mapInPandas(rows, "doc_id long, n long, set_key binary, tokens array<long>")


def named_tokens(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(token, rep) of the tokens that more than one of classes (rep, tokens) has, without each one's `hot` most frequent.

    Tokens are taken in SLICES turns; one that many sets have is counted where it is read, and Spark splits its join.
    """
    each, met = classes.select("rep", F.explode("tokens").alias("token")), None
    for k in range(SLICES):
        turn = each.where(F.pmod(F.shiftright("token", 7), F.lit(SLICES)) == k)
        some = written(turn.join(turn.groupBy("token").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "token"), "met")
        met = some if met is None else met.union(some)
    hottest = Window.partitionBy("rep", F.pmod("token", F.lit(CLASSES))).orderBy(F.desc("met"), "token")
    return met.withColumn("place", F.row_number().over(hottest)).where(F.col("place") > _of_class(F.col("token"), num, den, 1)).select("token", "rep")


def matched(named: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, leader, asks, inside), rep <> leader: sets with the groups that they may have links in, and with their own group.

    named: (token, rep). A token's leader is the set with the most company that has it, a set's group that of
    the token leader with the most company. asks: the group qualifies; inside: it is the set's own.
    """
    company = named.join(named.groupBy("token").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "token").groupBy("rep").agg(F.sum("met").alias("company"))
    ranked = named.join(company, "rep").select("token", "rep", F.struct("company", (-F.col("rep")).alias("r")).alias("rank"))
    leaders = ranked.groupBy("token").agg(F.max("rank").alias("rank"))
    homes = named.join(leaders, "token").groupBy("rep").agg((-F.max("rank")["r"]).alias("home"))
    settled = written(named.join(homes, "rep"), "settled")
    matrix = settled.groupBy("token", "home").agg(F.count(F.lit(1)).alias("held")).select("token", F.col("home").alias("leader"), "held")
    # Of two sets in different groups, the one whose group's leader has the smaller id asks the other's group.
    asked = settled.join(matrix, "token").where((F.col("home") < F.col("leader")) | ((F.col("home") == F.col("leader")) & (F.col("held") > 1))).groupBy("rep", "leader", F.pmod("token", F.lit(CLASSES)).alias("class")).agg(F.count(F.lit(1)).alias("shared"))
    opens = asked.where(F.col("shared") >= _of_class(F.col("class"), num, den, 2)).select("rep", "leader", F.lit(True).alias("asks"), F.lit(False).alias("inside"))
    roles = opens.union(homes.select("rep", "home", F.lit(False), F.lit(True)))
    return roles.where("rep <> leader").groupBy("rep", "leader").agg(F.max("asks").alias("asks"), F.max("inside").alias("inside"))


def differences(pairs: DataFrame, texts: DataFrame, width: int, whole: bool) -> DataFrame:
    """pairs (rep, leader, asks, inside) with both set sizes and in how many shingles they are `apart`.

    If whole, also what the rep has beyond the leader (`new`) and lacks of it (`gone`), which are null else.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=64)
        def leader_set(body: bytes) -> np.ndarray:
            return shingles(open_.decompress(body), width)

        for pdf in batches:
            out = []
            for rep, leader, asks, inside, body, leader_body in zip(pdf["rep"], pdf["leader"], pdf["asks"], pdf["inside"], pdf["body"], pdf["leader_body"]):
                a, b = shingles(open_.decompress(body), width), leader_set(bytes(leader_body))
                new, gone = np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
                out.append((rep, leader, asks, inside, len(a), len(b), len(new) + len(gone), new.view(np.int64) if whole else None, gone.view(np.int64) if whole else None))
            yield pd.DataFrame(out, columns=["rep", "leader", "asks", "inside", "n", "leader_n", "apart", "new", "gone"])

    led = pairs.join(texts.select(F.col("rep").alias("leader"), F.col("body").alias("leader_body")), "leader")
    both = led.join(texts.select("rep", "body"), "rep")
    return both.select("rep", "leader", "asks", "inside", "body", "leader_body").mapInPandas(rows, "rep long, leader long, asks boolean, inside boolean, n long, leader_n long, apart long, new array<long>, gone array<long>")


def pressed(documents: DataFrame) -> DataFrame:
    """(rep, body): the texts of documents (doc_id, text), compressed."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"rep": pdf["doc_id"], "body": [press.compress((t or "").encode("utf-8", "replace")) for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(rows, "rep long, body binary")


def linked(apart: F.Column, total: F.Column, num: int, den: int) -> F.Column:
    """den * intersection >= num * union, by how many shingles differ and the sum of the sizes."""
    return (den + num) * apart <= (den - num) * total


def opened(members: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b): the links in groups, other than to the base, of members (rep, leader, asks, inside, n, leader_n, apart, far, part, leader_part).

    part and leader_part name what is linked already, so only links between different parts are sought. Partners are
    about as far from the base as each other: who is part of the base already is only looked at if someone who isn't
    is within the widest distance of a link, and the latter only if anyone is.
    """
    widest = lambda n: F.floor(F.col(n) * (den - num) / num)
    loose = F.col("far") & (F.col("part") != F.col("leader_part"))
    groups = members.groupBy("leader").agg(F.max(loose).alias("any_loose"), F.max("n").alias("top")).where("any_loose").select("leader", (widest("top") + 1).alias("step"))
    placed = members.withColumn("loose", loose).join(groups, "leader").withColumn("cell", F.floor(F.col("apart") / F.col("step")))
    crowds = placed.groupBy("leader", "cell").agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("loose"), 1)).alias("open"))
    crowds = crowds.select("leader", F.explode(F.array(*[F.col("cell") + i for i in (-1, 0, 1)])).alias("cell"), "k", "open").groupBy("leader", "cell").agg(F.sum("k").alias("k"), F.sum("open").alias("open")).where("k > 1 and open > 0")
    chosen = written(placed.join(crowds.select("leader", "cell"), ["leader", "cell"]).select("rep", "leader", "asks", "inside", "far", "part"), "chosen")
    inside = differences(chosen.drop("far", "part"), texts, width, True).join(chosen.select("rep", "leader", "far", "part"), ["rep", "leader"])
    inside = written(inside, "inside")
    cells = inside.select("leader", "rep", "inside", F.explode(F.concat(
        F.transform("new", lambda t: F.struct(t.alias("token"), F.lit(True).alias("is_new"))),
        F.transform("gone", lambda t: F.struct(t.alias("token"), F.lit(False).alias("is_new"))))).alias("t")).select("leader", "rep", "inside", "t.*")
    # The union of the members' differences: what a query has besides base and union, no member has.
    matrix = cells.groupBy("leader", "token").agg(F.count(F.lit(1)).alias("seen"), F.sum(F.col("inside").cast("int")).alias("held"))
    rare = Window.partitionBy("leader", "rep").orderBy("seen", "token")
    each = Window.partitionBy("leader", "rep")
    strange = F.col("is_new") & (F.col("held") == F.col("inside").cast("int"))
    ranked = cells.join(matrix, ["leader", "token"]).withColumn("place", F.row_number().over(rare)).withColumn("strange", F.sum(strange.cast("int")).over(each))
    ranked = ranked.drop("inside").join(inside.select("leader", "rep", "asks", "inside", "n", "leader_n", "apart", "far", "part"), ["leader", "rep"])
    qualifies = F.col("inside") | (den * (F.col("n") - F.col("strange")) >= num * F.col("n"))
    least_far = F.col("apart") - widest("n") - 1
    least_near = F.floor(((den + num) * F.col("apart") + (den - num) * (F.col("leader_n") - F.col("n"))) / (2 * (den + num)))
    least = F.greatest(F.lit(1), F.when(F.col("far"), least_far).otherwise(least_near)).cast("long")
    prefixes = written(ranked.where(qualifies & (F.col("seen") > 1) & (F.col("place") <= F.col("apart") - least + 1)).select("leader", "token", "rep", "asks", "inside", "n", "apart", "far", "part", "place"), "prefixes")
    a, b = prefixes.where("asks").alias("a"), prefixes.where("inside").alias("b")
    total, both = F.col("a.n") + F.col("b.n"), F.col("a.apart") + F.col("b.apart")
    # Twice the shared differences must reach this; behind the places of the two tokens there must be so many left.
    needed = (den + num) * both - (den - num) * total
    left = 1 + F.least(F.col("a.apart") - F.col("a.place"), F.col("b.apart") - F.col("b.place"))
    may = (num * F.greatest("a.n", "b.n") <= den * F.least("a.n", "b.n")) & (2 * (den + num) * left >= needed)
    met = a.join(b, (F.col("a.leader") == F.col("b.leader")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.part") != F.col("b.part")) & (F.col("a.far") | F.col("b.far")) & may)
    pairs = met.select("a.leader", F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).distinct()
    side = lambda x: inside.select("leader", F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("apart").alias(f"apart_{x}"), F.concat("new", "gone").alias(f"diff_{x}"))
    known = pairs.join(side("a"), ["leader", "a"]).join(side("b"), ["leader", "b"])
    apart = F.col("apart_a") + F.col("apart_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    return known.where(linked(apart, F.col("n_a") + F.col("n_b"), num, den)).select("a", "b")


def similar_groups(documents: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of documents (doc_id, text).

    Documents link when den * intersection >= num * union of their sets of `width`-word shingles; component_id
    is the smallest doc_id reachable by links. Null, empty and blank texts have no shingles and link with
    nothing. Very long texts are read whole. Rows that share a doc_id count as one document with the links of
    each; rows without a doc_id link with nothing and get no component. Of ties the smallest doc_id leads.
    Other columns are not read, whatever their names. An empty table gives no rows.
    """
    docs = written(shingled(documents, width, num, den), "shingled")
    live = docs.where("n > 0 and doc_id is not null")
    classes = written(live.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")), "classes")
    named = written(named_tokens(classes, num, den), "named")
    pairs = written(matched(named, num, den), "matched")
    wanted = pairs.select("rep").union(pairs.select("leader")).distinct().withColumnRenamed("rep", "doc_id")
    texts = written(pressed(documents.select("doc_id", "text").join(wanted, "doc_id", "left_semi")), "texts")
    apart = differences(pairs, texts, width, False).drop("new", "gone")
    members = written(apart.withColumn("far", ~linked(F.col("apart"), F.col("n") + F.col("leader_n"), num, den)), "members")
    discarded(named, pairs)
    near = members.where("not far").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    parts = components(near)
    part = lambda of, name: parts.select(F.col("node").alias(of), F.col("component").alias(name))
    known = members.join(part("rep", "part"), "rep", "left").join(part("leader", "leader_part"), "leader", "left")
    known = known.withColumns({"part": F.coalesce("part", "rep"), "leader_part": F.coalesce("leader_part", "leader")})
    found = components(near.union(opened(known, texts, width, num, den)))
    joined = classes.join(found, classes["rep"] == found["node"], "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    rows = docs.select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    none = F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").isNull()
    alone = rows.where(none).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where(~none).join(joined, "set_key").select("doc_id", "n_shingles", "component_id").union(alone)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)
