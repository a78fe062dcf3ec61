"""What several operators share: tables, written intermediate results, and component labels."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go as soon as the query has ended.
DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker gets at once: texts can be long, and a worker holds a batch in several forms.
BATCH, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a folder of our own only where none is configured, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="genoforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers of the session get ROWS_AT_ONCE rows at once."""
    spark.conf.set(BATCH, ROWS_AT_ONCE)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: later passes and lost executors start from the files.

    Nothing reads the shuffle files of this write again, so Spark is told to drop them when it has ended. Python
    workers get small batches.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    held = {key: spark.conf.get(key, None) for key in (DROPS_SHUFFLES, BATCH)}
    spark.conf.set(DROPS_SHUFFLES, "true")
    spark.conf.set(BATCH, ROWS_AT_ONCE)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, before in held.items():
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Each round gives a node the smallest label among its neighbours and itself, then the label of that
    label, so a chain shortens by more than half; hubs are joined and aggregated, never gathered. It ends when no
    label moves any more, which every round brings nearer.
    """
    both = written(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .transform(lambda e: e.union(e.select(F.col("v"), F.col("u"))))
        .distinct(),
        "edges",
    )
    labels = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).withColumn("moved", F.lit(True)), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        hop = labels.select(F.col("u").alias("label"), F.col("label").alias("hop"))
        least = F.least("label", "near", "hop")
        new = written(labels.select("u", "label").join(near, "u").join(hop, "label", "left").select("u", least.alias("label"), (least < F.col("label")).alias("moved")), "labels")
        discarded(labels)
        labels = new
        if labels.where("moved").limit(1).count() == 0:
            discarded(both)
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))
