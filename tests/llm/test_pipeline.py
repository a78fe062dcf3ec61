from pyspark.sql import functions as F

import corpus_pipeline
from genoforge.llm import exact_dedup, jaccard_join, mixing, quality
from genoforge.llm.common import table

from . import cases

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark):
    docs = table(spark, SF, "documents")
    (_, by_quality), (_, exact), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = by_quality(spark, docs, SF)
    assert ids(kept) == ids(quality.quality_scores(docs, table(spark, SF, "labels")).where("predicted = 1")) and kept.columns == docs.columns
    kept = kept.cache()
    assert ids(exact(spark, kept, SF)) == ids(exact_dedup.exact_duplicates(kept).where("kept"))
    assert ids(near(spark, kept, SF)) == ids(jaccard_join.similar_groups(kept).where("doc_id = component_id"))
    want = sorted(r.doc_id for r in mixing.mixed(kept).collect() for _ in range(r.copies))
    mixed = mix(spark, kept, SF)
    assert ids(mixed) == want and mixed.columns == docs.columns
    assert {r.doc_id for r in pack(spark, mixed, SF).select("doc_id").collect()} == set(want)


def test_awkward_rows(spark):
    """Nulls, repeated ids and rows, very long texts, columns named like the operators' own, empty tables."""
    docs = cases.documents(spark).withColumn("row", F.lit(1)).withColumn("g", F.lit(2)).withColumn("c", F.lit(3)).withColumn("col", F.lit(4)).withColumn("_copies", F.lit(5))
    docs = docs.union(docs.where("doc_id = 7 or doc_id is null").withColumn("text", F.lit("of its own, whatever the number"))).cache()
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and kept.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0
    exact = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert exact.where("doc_id = 7 and text like 'of its own%'").count() == 1 and exact.where("doc_id is null and text like 'of its own%'").count() == 0
    assert exact.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("t")).distinct().count() == exact.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0
