"""Replicates as bits: each person's label in all of them, and what carriers sum to under them.

A label is drawn once for each person and travels as a bit. Rows of a key meet in one task, which reads them in order and
leaves one row of sums, so nothing is shuffled for each replicate and a task holds the sums of a batch's keys only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.permute import permuted

#: Rows of one key that are put together before they are summed.
ROWS = 1 << 16


def labelled(ranks: DataFrame, replicates: int, first: int = 0) -> DataFrame:
    """(indiv_id, labels): of people (indiv_id, aff, rank, of, cases), who is a case as they are (bit 0) and in the replicates with the keys first + 1 ..."""

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank, of, cases = (pdf[c].to_numpy() for c in ("rank", "of", "cases"))
            case = np.zeros((len(pdf), replicates + 1), bool)
            case[:, 0] = pdf["aff"] == 2
            for rep in range(1, replicates + 1):
                case[:, rep] = permuted(rank, of, first + rep) < cases
            yield pd.DataFrame({"indiv_id": pdf["indiv_id"], "labels": [x.tobytes() for x in np.packbits(case, axis=1)]})

    return ranks.select("indiv_id", "aff", "rank", "of", "cases").mapInPandas(drawn, "indiv_id long, labels binary")


def unpacked(labels: pd.Series, replicates: int) -> np.ndarray:
    """Labels as rows of 0 and 1."""
    bits = np.frombuffer(b"".join(labels), np.uint8).reshape(len(labels), -1)
    return np.unpackbits(bits, axis=1, count=replicates + 1)


def ordered(df: DataFrame, key: str, *then: str) -> DataFrame:
    """df with the rows of a key together and in order."""
    return df.repartition(key).sortWithinPartitions(key, *then)


def summed(batches: Iterator[pd.DataFrame], key: str, values: Callable[[pd.DataFrame], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, sums) of values (a row of numbers for each row) of batches in order of the key; a key comes once, when all its rows were read."""
    last, held = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = pdf[key].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sums = np.add.reduceat(values(pdf), starts, axis=0, dtype=np.int64)
        found = keys[starts]
        if held is not None and found[0] == last:
            sums[0] += held
        elif held is not None:
            yield np.array([last]), held[None]
        if len(found) > 1:
            yield found[:-1], sums[:-1]
        last, held = found[-1], sums[-1].copy()
    if held is not None:
        yield np.array([last]), held[None]


def label_sums(carriers: DataFrame, key: str, replicates: int) -> DataFrame:
    """(key, n, ca): carriers (key, labels) of each key, and how many of them are cases in the data and in each replicate."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = lambda pdf: np.concatenate([np.ones((len(pdf), 1), np.uint8), unpacked(pdf["labels"], replicates)], axis=1)
        for keys, sums in summed(batches, key, rows):
            yield pd.DataFrame({key: keys, "n": sums[:, 0], "ca": list(sums[:, 1:].astype(np.int32))})

    return ordered(carriers.select(key, "labels"), key).mapInPandas(counted, f"{key} long, n long, ca array<int>")


def by_replicate(sums: DataFrame, key: str) -> DataFrame:
    """(key, rep, ca, cu) of what label_sums gives."""
    return sums.select(key, "n", F.posexplode("ca").alias("rep", "c")).select(key, "rep", F.col("c").cast("long").alias("ca"), (F.col("n") - F.col("c")).alias("cu"))


def whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Batches in order of the key, cut anew so that none parts a key."""
    left = None
    for pdf in batches:
        pdf = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        if len(pdf):
            keys = pdf[key].to_numpy()
            at = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if at:
                yield pdf.iloc[:at]
            left = pdf.iloc[at:]
    if left is not None and len(left):
        yield left


def pieces(batches: Iterator[pd.DataFrame], key: str, person: str, arrays: Callable[[pd.DataFrame], dict[str, np.ndarray]], rows: int = ROWS) -> Iterator[tuple[int, dict[str, np.ndarray], bool]]:
    """(key, its rows as arrays, whether they are its last) of batches in order of key and person.

    A key of more than `rows` rows comes in several pieces; a person's rows stay together.
    """
    held: dict[str, np.ndarray] = {}
    for pdf in batches:
        new = arrays(pdf)
        held = {c: np.concatenate([held[c], v]) for c, v in new.items()} if held else new
        keys = held[key]
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(starts[:-1], starts[1:]):
            yield keys[a], {c: v[a:b] for c, v in held.items()}, True
        held = {c: v[starts[-1] :] for c, v in held.items()}
        who = held[person]
        at = int(np.flatnonzero(np.r_[True, who[1:] != who[:-1]])[-1])
        if len(who) > rows and at:
            yield held[key][0], {c: v[:at] for c, v in held.items()}, False
            held = {c: v[at:] for c, v in held.items()}
    if held and len(held[key]):
        yield held[key][0], held, True
