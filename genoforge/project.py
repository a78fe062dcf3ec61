"""A project: a folder of Parquet tables with the upkeep commands of a variant database.

Each table is written as a new version beside the old one, and the newest version is read; a failed job leaves
the project as it was. Indexes aren't needed: files are in ranges of (chr, bp1), whose statistics Spark reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.1"


class Project:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, path: str) -> list[str]:
        fs, make = self._fs()
        return [s.getPath().getName() for s in fs.listStatus(make(path))] if fs.exists(make(path)) else []

    def _versions(self, table: str) -> list[int]:
        fs, make = self._fs()
        found = [int(n[1:]) for n in self._names(f"{self.path}/{table}") if re.fullmatch(r"v\d+", n)]
        return sorted(v for v in found if fs.exists(make(f"{self.path}/{table}/v{v}/_SUCCESS")))

    def tables(self) -> list[str]:
        return sorted(t for t in self._names(self.path) if self._versions(t))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}/v{self._versions(table)[-1]}")

    def write(self, table: str, df: DataFrame) -> None:
        """write-vardb and every loader: the table's next version, in ranges of (chr, bp1) where it has these."""
        if {"chr", "bp1"} <= set(df.columns):
            df = df.repartitionByRange("chr", "bp1").sortWithinPartitions("chr", "bp1")
        taken = [int(n[1:]) for n in self._names(f"{self.path}/{table}") if re.fullmatch(r"v\d+", n)]
        df.write.parquet(f"{self.path}/{table}/v{max(taken, default=0) + 1}")

    def append(self, table: str, df: DataFrame) -> None:
        self.write(table, self.read(table).unionByName(df, allowMissingColumns=True) if self._versions(table) else df)

    def delete(self, table: str, condition: str) -> None:
        """var-delete, loc-delete, seg-delete, delete-meta, var-drop-set, loc-delete-alias, ...: all rows but those of a condition."""
        self.write(table, self.read(table).where(f"NOT coalesce({condition}, false)"))

    def drop(self, table: str) -> None:
        fs, make = self._fs()
        fs.delete(make(f"{self.path}/{table}"), True)

    def vacuum(self) -> None:
        """Removes all versions but the newest; no job may be reading older ones."""
        fs, make = self._fs()
        for t in self.tables():
            for v in self._versions(t)[:-1]:
                fs.delete(make(f"{self.path}/{t}/v{v}"), True)

    def rename(self, table: str, column: str, names: DataFrame) -> None:
        """swap-ids, loc-swap-names, tag-file: values of a column by (old, new)."""
        from .sources.readers import swap_ids

        self.write(table, swap_ids(self.read(table), names, column))

    def set_special(self, key: str, values: list[str]) -> None:
        """loc-set-special: values of a key, e.g. pseudo-autosomal regions."""
        rows = self.spark.createDataFrame([(key, k, v) for k, v in enumerate(values)], "key string, place int, value string")
        self.append("special", rows)

    def special(self, key: str) -> DataFrame:
        return self.read("special").where(F.col("key") == key).orderBy("place").select("value")

    def add_set(self, name: str, members: DataFrame, superset: str | None = None) -> None:
        """var-set and var-superset: variants (var_id) under a set, and the set under a superset."""
        self.append("var_sets", members.select("var_id", F.lit(name).alias("set_name"), F.lit(superset).cast("string").alias("superset_name")))

    def attach_meta(self, group: str, values: DataFrame) -> None:
        """attach-meta: (var_id, key, value) under a group, kept apart from the variants."""
        self.append("meta", values.select("var_id", F.lit(group).alias("grp"), "key", "value"))

    def with_meta(self, variants: DataFrame, groups: list[str] | None = None) -> DataFrame:
        """meta.attach: variants with a map of the values of some or all groups."""
        m = self.read("meta")
        m = m.where(F.col("grp").isin(groups)) if groups else m
        return variants.join(m.groupBy("var_id").agg(F.map_from_entries(F.collect_set(F.struct("key", "value"))).alias("meta")), "var_id", "left")

    def summary(self) -> DataFrame:
        """(table, version, rows) of all tables."""
        rows = [self.read(t).agg(F.lit(t).alias("table"), F.lit(self._versions(t)[-1]).alias("version"), F.count(F.lit(1)).alias("rows")) for t in self.tables()]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out


def commands() -> list[str]:
    """Names of all commands that are queries."""
    from .queries import QUERIES

    return sorted(n for n in QUERIES if not n.startswith("mask_"))


def masks() -> list[str]:
    from .plans.mask import TERMS

    return TERMS
