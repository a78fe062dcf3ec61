"""Views of a study: variants, genotypes, groups, loci, reference variants, segments and proteins, and matrices of them.

Long rows stand where a listing would nest: a variant's genotypes, a group's variants, a locus's sets. Reference
homozygotes have no rows and are listed only where they carry the minor allele.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.study import Study, counted
from .intervals import points_in


def v_view(study: Study) -> DataFrame:
    """A row for each variant with the files that it is seen in."""
    seen = study.calls.groupBy("var_id").agg(F.array_join(F.array_sort(F.collect_set("file_id")), ",").alias("files"), F.count(F.lit(1)).alias("calls"))
    return study.variants.select("var_id", "chr", "bp1", "name", "ref", "alt", "filter", "qual").join(seen, "var_id", "left").fillna({"files": "", "calls": 0})


def label(ac: Column) -> Column:
    """A diploid genotype's alleles."""
    side = lambda k: F.when(ac.isNull(), ".").when(ac >= k, F.col("alt")).otherwise(F.col("ref"))
    return F.concat(side(2), F.lit("/"), side(1))


def v_view_genotypes(study: Study, hide_null: bool = False, only_alt: bool = False) -> DataFrame:
    """(var_id, indiv_id, genotype) of carriers and missing genotypes; hide_null and only_alt leave out missing ones."""
    g = study.geno.where("ac > 0") if only_alt else study.geno.where("ac is not null") if hide_null else study.geno
    return g.join(study.variants.select("var_id", "ref", "alt"), "var_id").join(study.indiv.select("indiv_id"), "indiv_id").select("var_id", "indiv_id", label(F.col("ac")).alias("genotype"))


def minor_carriers(study: Study) -> DataFrame:
    """(var_id, indiv_id, ac) of those who carry the minor allele.

    Where ALT is the commoner allele these are all people but ALT homozygotes and missing genotypes, most of them
    without a row; the few variants of that kind are listed for everyone, as the view itself does.
    """
    v = counted(study).select("var_id", "flip")
    g = study.geno.join(study.indiv.select("indiv_id"), "indiv_id")
    few = g.join(v.where("not flip"), "var_id", "left_semi").where("ac > 0").select("var_id", "indiv_id", "ac")
    flipped = v.where("flip").select("var_id")
    most = flipped.crossJoin(study.indiv.select("indiv_id")).join(g.join(flipped, "var_id", "left_semi"), ["var_id", "indiv_id"], "left_anti").select("var_id", "indiv_id", F.lit(0).alias("ac"))
    return few.union(most).union(g.join(flipped, "var_id", "left_semi").where("ac < 2").select("var_id", "indiv_id", "ac"))


def rv_view(study: Study) -> DataFrame:
    """The genotypes of rare-allele carriers."""
    return minor_carriers(study).join(study.variants.select("var_id", "chr", "bp1", "ref", "alt"), "var_id").select("var_id", "chr", "bp1", "indiv_id", label(F.col("ac")).alias("genotype"))


def mv_view(study: Study) -> DataFrame:
    """All variants of the mask as one group, with the ALT counts of cases and controls."""
    return counted(study).select(F.lit("all").alias("grp"), "var_id", "chr", "bp1", "ref", "alt", F.col("a_ac").alias("case_alt"), F.col("u_ac").alias("control_alt"))


def mrv_view(study: Study) -> DataFrame:
    """The carriers of all variants of the mask as one group: how many rare variants each has."""
    return minor_carriers(study).groupBy("indiv_id").agg(F.count(F.lit(1)).alias("variants"), F.sum("ac").alias("alt")).withColumn("grp", F.lit("all"))


def in_genes(study: Study) -> DataFrame:
    """(gene, var_id): a variant is in every gene that holds it."""
    return points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("altname", "chr", "bp1", "bp2")).select(F.col("i_altname").alias("gene"), "var_id").distinct()


def g_view(study: Study) -> DataFrame:
    """Variants by gene with the ALT counts of cases and controls."""
    v = counted(study).select("var_id", "chr", "bp1", "ref", "alt", F.col("a_ac").alias("case_alt"), F.col("u_ac").alias("control_alt"))
    return in_genes(study).join(v, "var_id").select("gene", "var_id", "chr", "bp1", "ref", "alt", "case_alt", "control_alt")


def g_view_rarelist(study: Study) -> DataFrame:
    """By gene and person: the rare variants carried, in order of position."""
    v = minor_carriers(study).join(in_genes(study), "var_id").join(study.variants.select("var_id", "bp1"), "var_id")
    at = F.array_sort(F.collect_list(F.struct("bp1", "var_id")))
    return v.groupBy("gene", "indiv_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(at, lambda x: x["var_id"].cast("string")), ",").alias("var_ids"))


def loc_view(study: Study, group: int | None = None) -> DataFrame:
    """Loci with their length and the sets that hold them."""
    loci = study.loci if group is None else study.loci.where(F.col("group_id") == group)
    sets = study.sets.groupBy("loc_id").agg(F.array_join(F.array_sort(F.collect_set("set_name")), "|").alias("sets"))
    return loci.select("loc_id", "group_id", "altname", "chr", "bp1", "bp2", (F.col("bp2") - F.col("bp1") + 1).alias("bases")).join(sets, "loc_id", "left").fillna({"sets": ""})


def ref_view(study: Study, group: str) -> DataFrame:
    """The reference variants of a group."""
    return study.refs.where(F.col("grp") == group).select("grp", "name", "chr", "bp1", "alt")


def seg_view(study: Study) -> DataFrame:
    """Segments of the people in the mask."""
    return study.segments.join(study.indiv.select("indiv_id", "aff"), "indiv_id").select("indiv_id", "aff", "seg", "n")


def prot_view(study: Study) -> DataFrame:
    """Features of each transcript with the variants that lie in them."""
    met = points_in(study.variants.select("var_id", "chr", "bp1"), study.proteins)
    return met.select(F.col("i_transcript").alias("transcript"), F.col("i_source").alias("source"), F.col("i_feature").alias("feature"), "var_id")


def v_matrix(study: Study, people: list[int]) -> DataFrame:
    """Variants x stated people: ALT counts, -1 for missing."""
    g = study.geno.where(F.col("indiv_id").isin(people)).withColumn("ac", F.coalesce("ac", F.lit(-1)))
    wide = g.groupBy("var_id").pivot("indiv_id", people).agg(F.first("ac"))
    return study.variants.select("var_id").join(wide, "var_id", "left").fillna(0).select("var_id", *[F.col(str(i)).alias(f"i{i}") for i in people])


def meta_matrix(study: Study, fields: list[str]) -> DataFrame:
    """Variants x stated fields."""
    return study.variants.select("var_id", "chr", "bp1", *fields)


def v_meta_matrix(study: Study, people: list[int], field: str = "dp") -> DataFrame:
    """Variants x stated people: a genotype field, the largest over files; null where nothing is stored."""
    wide = study.calls.where(F.col("indiv_id").isin(people)).groupBy("var_id").pivot("indiv_id", people).agg(F.max(field))
    return wide.join(study.variants.select("var_id"), "var_id", "left_semi").select("var_id", *[F.col(str(i)).alias(f"i{i}") for i in people])


def g_meta_matrix(study: Study, field: str = "dp") -> DataFrame:
    """(gene, indiv_id, mean, n): a genotype field averaged over a gene's stored genotypes, the long form of the matrix."""
    c = study.calls.groupBy("var_id", "indiv_id").agg(F.max(field).alias("x"))
    return c.join(in_genes(study), "var_id").groupBy("gene", "indiv_id").agg(F.avg("x").alias("mean"), F.count("x").alias("n"))


def seg_summary(study: Study) -> DataFrame:
    """Segments, people and events by number of segments of a person."""
    each = study.segments.groupBy("indiv_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("events"))
    return each.groupBy("segments").agg(F.count(F.lit(1)).alias("people"), F.sum("events").alias("events"))


def seq_summary(study: Study) -> DataFrame:
    """Sequences with their extents."""
    n = F.length("seq")
    return study.seqs.agg(F.count("seq").alias("sequences"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.sum(n).alias("bases"))


def prot_summary(study: Study) -> DataFrame:
    """Features, kinds of features and transcripts by source."""
    return study.proteins.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("feature").alias("features"), F.countDistinct("transcript").alias("transcripts"))


def meta_summary(study: Study) -> DataFrame:
    """Fields of variants and genotypes with their types."""
    rows = [(table, name, kind) for table, df in (("variant", study.variants), ("genotype", study.calls)) for name, kind in df.dtypes]
    return study.variants.sparkSession.createDataFrame(rows, "level string, field string, type string")


def score_weights(study: Study, weights: DataFrame) -> DataFrame:
    """(indiv_id, score, n): a person's ALT alleles times the weights (var_id, weight) of the variants, and how many have one."""
    g = study.geno.where("ac > 0").join(weights, "var_id")
    return g.groupBy("indiv_id").agg(F.sum(F.col("ac") * F.col("weight")).alias("score"), F.count(F.lit(1)).alias("n"))
