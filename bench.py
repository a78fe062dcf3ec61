"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The study is written once, as a user would keep it, and timed as `study`; queries read the written tables. If a
folder of a tenth of the size lies beside the given one, the same queries run there, too: `growth` is how many
times longer the larger one takes.
"""

import dataclasses
import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from genoforge.plans.study import Study
from genoforge.queries import MAKE
from genoforge.sources.projection import study

HEADLINE = ["counts_by_locus", "v_freq", "counts", "means", "v_stats", "g_stats", "i_stats", "v_dist", "v_assoc", "glm_linear", "gene_tests", "concordance", "denovo", "proximity", "loc_intersect", "loc_subtract", "net_view_2", "seq_stats", "mask_loc", "mask_maf", "mask_both", "lookup"]


def kept(s: Study, folder: str) -> Study:
    """The study with each of its tables written to the folder and read back."""
    tables = {f.name: getattr(s, f.name) for f in dataclasses.fields(s) if isinstance(getattr(s, f.name), DataFrame)}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    return s.but(**{name: df.sparkSession.read.parquet(f"{folder}/{name}") for name, df in tables.items()})


def timed(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    began = time.time()
    s = kept(study(spark, sf_dir), tempfile.mkdtemp(prefix="bench-"))
    took = {"study": round(time.time() - began, 3)}
    MAKE["counts_by_locus"](s).count()  # starts the JVM's compilers
    for name in HEADLINE:
        began = time.time()
        MAKE[name](s).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    return took


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scale = os.path.basename(sf_dir).removeprefix("sf")
    small = os.path.join(os.path.dirname(sf_dir), f"sf{float(scale) / 10:g}") if scale.replace(".", "", 1).isdigit() else ""
    before = timed(spark, small) if os.path.isdir(small) else {}
    took = timed(spark, sf_dir)
    out = {"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": scale}
    if before:
        out["growth"] = {k: round(took[k] / max(before[k], 1e-3), 2) for k in took}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
