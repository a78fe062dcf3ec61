"""Loci, sequences, networks and tables of people: set algebra, content, translation and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import is_transition
from ..plans.study import Study, counted
from .intervals import merged, overlaps, points_in, subtracted

# The standard genetic code, by first, second and third base in the order T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def loc_intersect(study: Study) -> DataFrame:
    """By locus of group 0: how many and which genes of other groups overlap it."""
    met = overlaps(study.loci.where("group_id = 0"), study.loci.where("group_id <> 0"))
    return met.groupBy(F.col("a_loc_id").alias("loc_id")).agg(F.countDistinct("b_altname").alias("n"), F.array_join(F.array_sort(F.collect_set("b_altname")), "|").alias("genes"))


def loc_overlap(study: Study, a: int = 0, b: int = 1) -> DataFrame:
    met = overlaps(study.loci.where(F.col("group_id") == a), study.loci.where(F.col("group_id") == b))
    return met.select(F.col("a_loc_id").alias("loc_a"), F.col("b_loc_id").alias("loc_b"), "intersection", "joint")


def loc_merge(study: Study) -> DataFrame:
    """Loci of one name as one, with their number of parts."""
    return study.loci.groupBy("group_id", "altname", "chr").agg(F.min("bp1").alias("bp1"), F.max("bp2").alias("bp2"), F.count(F.lit(1)).alias("parts"))


def loc_flatten(study: Study) -> DataFrame:
    return merged(study.loci)


def loc_subtract(study: Study, a: int = 0, b: int = 1) -> DataFrame:
    return subtracted(study.loci.where(F.col("group_id") == a), study.loci.where(F.col("group_id") == b))


def name_intersection(study: Study, a: int = 0, b: int = 1) -> DataFrame:
    """(altname, a, b): names that two groups share, with how many loci each has of them; positions don't matter."""
    named = study.loci.where(F.col("group_id").isin(a, b)).groupBy("altname").agg(F.count(F.when(F.col("group_id") == a, 1)).alias("a"), F.count(F.when(F.col("group_id") == b, 1)).alias("b"))
    return named.where("a > 0 and b > 0")


def group_span(study: Study) -> DataFrame:
    """(group_id, chr, bp1, bp2, midpoint, n): from where to where a group's loci reach on each chromosome, and what lies halfway."""
    span = study.loci.groupBy("group_id", "chr").agg(F.min("bp1").alias("bp1"), F.max("bp2").alias("bp2"), F.count(F.lit(1)).alias("n"))
    return span.select("group_id", "chr", "bp1", "bp2", F.expr("bp1 + (bp2 - bp1) div 2").alias("midpoint"), "n")


def ref_range(study: Study, around: int = 0) -> DataFrame:
    """(var_id, grp, n, names): the reference sites within each variant's bases, or so many bases around them, by group."""
    spans = study.variants.select("var_id", "chr", (F.col("bp1") - around).alias("bp1"), (F.col("bp1") + F.length("ref") - 1 + around).alias("bp2"))
    met = points_in(study.refs.select("grp", "name", "chr", "bp1"), spans)
    return met.groupBy(F.col("i_var_id").alias("var_id"), "grp").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def intersect(study: Study) -> DataFrame:
    """Loci with a variant."""
    met = points_in(study.variants.select("chr", "bp1"), study.loci).select(F.col("i_loc_id").alias("loc_id")).distinct()
    return study.loci.join(met, "loc_id", "left_semi").select("loc_id", "altname")


def loc_summary(study: Study) -> DataFrame:
    return study.loci.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bp2") - F.col("bp1") + 1).alias("bases"))


def ref_summary(study: Study) -> DataFrame:
    return study.refs.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def var_summary(study: Study) -> DataFrame:
    return study.calls.groupBy("file_id").agg(F.countDistinct("var_id").alias("variants"), F.countDistinct("indiv_id").alias("people"), F.count(F.lit(1)).alias("calls"))


def ind_summary(study: Study) -> DataFrame:
    return study.pheno.groupBy("pheno").agg(F.count("value").alias("observed"), F.countDistinct("value").alias("values"))


def i_view(study: Study) -> DataFrame:
    """People with their phenotypes in columns."""
    wide = study.pheno.groupBy("indiv_id").pivot("pheno", ["aff", "qt", "strata"]).agg(F.first("value"))
    return study.indiv.select("indiv_id", "sex", "pat", "mat").join(wide, "indiv_id", "left")


def g_matrix(study: Study, collapse: bool = False) -> DataFrame:
    """(locus, person, ALT count) of carriers, the long form of the genes x people matrix; collapse gives 0/1."""
    v = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("altname", "chr", "bp1", "bp2")).select(F.col("i_altname").alias("gene"), "var_id").distinct()
    out = study.geno.where("ac > 0").join(v, "var_id").groupBy("gene", "indiv_id").agg(F.sum("ac").alias("ac"))
    return out.withColumn("ac", F.lit(1)) if collapse else out


def wide(long: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A matrix with stated columns from a long table; missing cells are 0."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value)).fillna(0)


def net_view(study: Study, depth: int = 1, threshold: float = 0.0) -> DataFrame:
    """(a, b, hops): nodes at most `depth` edges of at least `threshold` apart, with the fewest hops; one join a hop."""
    edges = study.edges.where(F.col("score") >= threshold).select("a", "b").distinct()
    near = edges.withColumn("hops", F.lit(1))
    for k in range(2, depth + 1):
        far = near.where(F.col("hops") == k - 1).join(edges.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"), F.lit(k).alias("hops")).where("a <> b")
        near = near.union(far).groupBy("a", "b").agg(F.min("hops").alias("hops"))
    return near


def net_carriers(study: Study) -> DataFrame:
    """By node: cases and controls that carry an ALT allele in the locus of the node or a neighbour."""
    near = study.edges.select(F.col("a").alias("seed"), F.col("b").alias("loc_id")).union(study.edges.select("a", F.col("a"))).distinct()
    v = points_in(study.variants.select("var_id", "chr", "bp1"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select(F.col("i_loc_id").alias("loc_id"), "var_id")
    carried = study.geno.where("ac > 0").join(v, "var_id").select("loc_id", "indiv_id").distinct()
    seeds = near.join(carried, "loc_id").select("seed", "indiv_id").distinct().join(study.indiv.select("indiv_id", "aff"), "indiv_id")
    return seeds.groupBy("seed").agg(F.count(F.when(F.col("aff") == 2, 1)).alias("cases"), F.count(F.when(F.col("aff") == 1, 1)).alias("controls"))


def seq_stats(study: Study) -> DataFrame:
    """By sequence: length, G and C, N and lower-case share, and CG dinucleotides."""
    s = F.col("seq")
    n = F.length(s)
    kept = lambda bases: n - F.length(F.translate(s, bases, ""))
    return study.seqs.select("doc_id", n.alias("length"), kept("GC").alias("gc"), kept("N").alias("n"), kept("ACGT").alias("acgt"), ((n - F.length(F.replace(s, F.lit("CG")))) / 2).cast("long").alias("cg"))


def kmers(study: Study, k: int = 2) -> DataFrame:
    """Overlapping k-mers of A, C, G and T over all sequences, counted."""
    bases = F.split("seq", "")  # once for all places; substrings of a long text would each be sought from its start
    grown = reduce(lambda a, i: F.zip_with(a, F.slice(bases, i, F.greatest(F.size(bases) - i + 1, F.lit(0))), lambda x, y: F.concat(x, y)), range(2, k + 1), bases)
    each = study.seqs.where(F.length("seq") >= k).select(F.explode(grown).alias("kmer")).where(F.length("kmer") == k)
    return each.where(~F.col("kmer").rlike("[^ACGT]")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def translated(seq: Column) -> Column:
    """Amino acids of whole codons; a codon with another letter is X."""
    code = {x + y + z: AMINO_ACIDS[16 * i + 4 * j + k] for i, x in enumerate("TCAG") for j, y in enumerate("TCAG") for k, z in enumerate("TCAG")}
    table = F.create_map(*[F.lit(v) for pair in code.items() for v in pair])
    codons = F.regexp_extract_all(F.upper(seq), F.lit("(.{3})"), F.lit(1))
    return F.when(F.length(seq) < 3, "").otherwise(F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), ""))


def loc_translate(study: Study, strand: str = "strand") -> DataFrame:
    """Amino acids of each sequence's A, C, G and T letters, read forwards."""
    return study.seqs.select("doc_id", translated(F.translate("seq", "BDEFHIJKLMNOPQRSUVWXYZbdefhijklmnopqrsuvwxyz .,\n", "")).alias("aa"))


def lookup(study: Study) -> DataFrame:
    """(var_id, key, value): what is known of each variant's position, in long form."""
    v = study.variants
    counts = counted(study).select("var_id", F.explode(F.create_map(F.lit("case_alt"), F.col("a_ac").cast("string"), F.lit("control_alt"), F.col("u_ac").cast("string"))).alias("key", "value"))
    own = v.select("var_id", F.explode(F.create_map(F.lit("alleles"), F.concat("ref", F.lit("/"), "alt"), F.lit("titv"), F.when(is_transition(F.col("ref"), F.col("alt")), "ti").otherwise("tv"))).alias("key", "value"))
    loci = points_in(v, study.loci).select("var_id", F.lit("locus").alias("key"), F.col("i_altname").alias("value")).distinct()
    refs = v.select("var_id", "chr", "bp1").join(study.refs.select("chr", "bp1", "grp"), ["chr", "bp1"]).select("var_id", F.concat(F.lit("ref_"), "grp").alias("key"), F.lit("1").alias("value")).distinct()
    return reduce(DataFrame.union, [own, counts, loci, refs])


def indiv_enrich(study: Study) -> DataFrame:
    """By person and locus set: genes hit in the set and elsewhere, against the set's part of all bases, one-sided z."""
    hit = points_in(study.geno.where("ac > 0").join(study.variants.select("var_id", "chr", "bp1"), "var_id"), study.loci.select("loc_id", "chr", "bp1", "bp2")).select("indiv_id", F.col("i_loc_id").alias("loc_id")).distinct()
    sets = study.sets.select("loc_id", F.col("superset_name").alias("set"))
    size = F.col("bp2") - F.col("bp1") + 1
    span = study.loci.join(sets, "loc_id").groupBy("set").agg(F.sum(size).alias("bases"))
    whole = study.loci.agg(F.sum(size).alias("whole"))
    part = span.crossJoin(F.broadcast(whole)).select("set", (F.col("bases") / F.col("whole")).alias("f"))  # one row
    own = hit.groupBy("indiv_id").agg(F.count(F.lit(1)).alias("total"))
    by = hit.join(sets, "loc_id").groupBy("indiv_id", "set").agg(F.count(F.lit(1)).alias("obs"))
    alpha = F.col("f") / (1 - F.col("f"))
    z = (F.col("obs") - alpha * (F.col("total") - F.col("obs"))) / F.sqrt(alpha * F.col("total"))
    return by.join(own, "indiv_id").join(part, "set").select("indiv_id", "set", "obs", "total", "f", z.alias("z"))
