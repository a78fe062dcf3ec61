"""Readers of the file formats of variant analysis, as DataFrames over Spark's own text readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def chromosome(name: Column) -> Column:
    """Integer code of a chromosome name; X is 23, Y 24, M 25, anything else null."""
    bare = F.regexp_replace(F.upper(name), "^CHR", "")
    return F.when(bare.isin("X", "XY", "PAR"), 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25).otherwise(bare.try_cast("int"))


def vcf_header(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(samples, declared fields (kind, id, number, type, description)); the header lines of a file are few."""
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    names = lines.where(F.col("value").startswith("#CHROM")).first()
    part = lambda key: F.regexp_extract("value", rf"[<,]{key}=([^,>]*)", 1)
    declared = lines.where(F.col("value").rlike("^##(INFO|FORMAT|FILTER)=<")).select(
        F.regexp_extract("value", "^##([A-Z]+)", 1).alias("kind"), part("ID").alias("id"), part("Number").alias("number"), part("Type").alias("type"), F.regexp_extract("value", 'Description="([^"]*)"', 1).alias("description"))
    return (names[0].split("\t")[9:] if names else []), declared


def vcf(spark: SparkSession, path: str, file_id: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """(variants, calls, samples) of a VCF, plain or compressed.

    variants: (var_id, chr, bp1, bp2, name, ref, alt, qual, filter, info map); calls: (file_id, var_id, indiv_id, ac,
    ploidy, phased, is_null, gmeta map), reference homozygotes included. An allele code beyond the ALTs makes a
    null genotype. var_id is a hash of the site, so that files loaded apart agree.
    """
    samples, _ = vcf_header(spark, path)
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"))
    pairs = F.transform(F.filter(F.split(F.col("f")[7], ";"), lambda x: x != "."), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    first = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)  # of a repeated key the first counts
    site = rows.select("f", chromosome(F.col("f")[0]).alias("chr"), F.col("f")[1].cast("long").alias("bp1"), F.col("f")[2].alias("name"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.col("f")[5].try_cast("double").alias("qual"), F.col("f")[6].alias("filter"), F.map_from_entries(first).alias("info"))
    site = site.withColumn("bp2", F.col("bp1") + F.length("ref") - 1).withColumn("var_id", F.xxhash64("chr", "bp1", "ref", "alt"))
    variants = site.select("var_id", "chr", "bp1", "bp2", "name", "ref", "alt", "qual", "filter", "info")
    keys = F.split(F.col("f")[8], ":")
    each = site.where(F.size("f") > 9).select("var_id", keys.alias("keys"), F.size(F.split("alt", ",")).alias("alts"), F.posexplode(F.slice("f", 10, max(len(samples), 1))).alias("k", "cell"))
    cell = F.split("cell", ":")
    gmeta = F.map_from_arrays(F.slice("keys", 1, F.least(F.size("keys"), F.size(cell))), F.slice(cell, 1, F.least(F.size("keys"), F.size(cell))))
    codes = F.transform(F.split(F.col("gmeta")["GT"], "[/|]"), lambda x: x.try_cast("int"))
    each = each.select("var_id", "alts", "k", gmeta.alias("gmeta")).withColumn("codes", codes)
    lost = F.col("codes").isNull() | F.exists("codes", lambda x: x.isNull() | (x > F.col("alts")))
    header = F.split("value", "\t")
    people = spark.read.text(path).where(F.col("value").startswith("#CHROM")).select(F.posexplode(F.slice(header, 10, F.greatest(F.size(header) - 9, F.lit(0)))).alias("k", "indiv_id"))
    calls = each.join(people, "k", "left").select(F.lit(file_id).alias("file_id"), "var_id", "indiv_id", F.when(~lost, F.size(F.filter("codes", lambda x: x > 0))).alias("ac"),
        F.size("codes").alias("ploidy"), F.contains(F.col("gmeta")["GT"], F.lit("|")).alias("phased"), lost.alias("is_null"), F.map_filter("gmeta", lambda k, v: k != "GT").alias("gmeta"))
    return variants, calls, samples


def delimited(spark: SparkSession, path: str, schema: str, sep: str = r"\s+", skip: str = "#") -> DataFrame:
    """Rows of a text file cut at a pattern, with a stated schema; rows of another width are left out."""
    columns = [c.split() for c in schema.split(",")]
    parts = spark.read.text(path).where(~F.col("value").startswith(skip) & (F.trim("value") != "")).select(F.split(F.trim("value"), sep).alias("f"))
    return parts.where(F.size("f") == len(columns)).select(*[F.col("f")[k].try_cast(t).alias(c) for k, (c, t) in enumerate(columns)])


def phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """(indiv_id, pheno, value, kind): `##name,type,missing,"desc"` lines declare, `#ID p1 p2` names; missing codes are null."""
    head = [r[0] for r in spark.read.text(path).where(F.col("value").startswith("#")).collect()]  # header lines
    declared = {p[0]: (p + ["Integer", "0"][len(p) - 1 :])[:3] for p in (h[2:].split(",") for h in head if h.startswith("##"))}
    names = next(h for h in head if not h.startswith("##"))[1:].split()[1:]
    rows = delimited(spark, path, ", ".join(["indiv_id string", *[f"p{k} string" for k in range(len(names))]]))
    long = rows.select("indiv_id", F.explode(F.array(*[F.struct(F.lit(n).alias("pheno"), F.nullif(F.col(f"p{k}"), F.lit(declared.get(n, [n, "", "0"])[2])).alias("value"), F.lit(declared.get(n, [n, "Integer"])[1]).alias("kind")) for k, n in enumerate(names)])).alias("x"))
    return long.select("indiv_id", "x.*")


def make_phenotype(indiv: DataFrame, pheno: DataFrame, name: str, cases: list[str], controls: list[str] | None = None) -> DataFrame:
    """(indiv_id, aff): 2 for the values of cases, 1 for those of controls; without controls everybody else, missing too."""
    v = pheno.where(F.col("pheno") == name).select("indiv_id", F.col("value").cast("string").alias("v"))
    rest = F.lit(1) if controls is None else F.when(F.col("v").isin(controls), 1)
    return indiv.select("indiv_id").join(v, "indiv_id", "left").select("indiv_id", F.when(F.col("v").isin(cases), 2).otherwise(rest).alias("aff"))


def pedigree(spark: SparkSession, path: str) -> DataFrame:
    """(indiv_id, fid, iid, pat, mat, sex); `.` and `0` are missing."""
    rows = delimited(spark, path, "indiv_id string, fid string, iid string, pat string, mat string, sex string")
    clean = lambda c: F.when(~F.col(c).isin(".", "0"), F.col(c)).alias(c)
    return rows.select("indiv_id", "fid", "iid", clean("pat"), clean("mat"), clean("sex"))


def gtf(spark: SparkSession, path: str, group_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(loci by transcript, their CDS, exon and codon parts) of a GTF."""
    rows = delimited(spark, path, "seq string, source string, feature string, bp1 long, bp2 long, score string, strand string, frame string, attrs string", "\t")
    name = lambda key: F.regexp_extract("attrs", rf'{key} "([^"]*)"', 1)
    parts = rows.where(F.col("feature").isin("CDS", "exon", "start_codon", "stop_codon")).select(name("transcript_id").alias("name"), name("gene_id").alias("altname"), chromosome(F.col("seq")).alias("chr"), "feature", "bp1", "bp2", "strand", F.col("frame").try_cast("int").alias("frame"))
    loci = parts.groupBy("name", "altname", "chr").agg(F.min("bp1").alias("bp1"), F.max("bp2").alias("bp2"), F.first("strand").alias("strand"), F.count(F.when(F.col("feature") == "exon", 1)).alias("exons"))
    return loci.select(F.xxhash64("name", "chr").alias("loc_id"), F.lit(group_id).alias("group_id"), "*"), parts


def gtf_check(parts: DataFrame) -> DataFrame:
    """Transcripts on several chromosomes or strands, without CDS, or whose CDS is no whole number of codons."""
    by = parts.groupBy("name").agg(F.countDistinct("chr").alias("chrs"), F.countDistinct("strand").alias("strands"), F.sum(F.when(F.col("feature") == "CDS", F.col("bp2") - F.col("bp1") + 1)).alias("cds"))
    fault = F.when(F.col("chrs") > 1, "chromosomes").when(F.col("strands") > 1, "strands").when(F.col("cds").isNull(), "no CDS").when(F.col("cds") % 3 != 0, "frame")
    return by.select("name", fault.alias("fault")).where("fault is not null")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """Regions of a table with a header: chr, bp1, bp2, or one position `chr:bp1..bp2`, and any other columns."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = rows.withColumnsRenamed({c: c.lstrip("#").lower() for c in rows.columns})
    if "position" in rows.columns:
        at = F.regexp_extract(F.col("position"), r"^([^:]+):(\d+)(?:(?:\.\.|-)(\d+))?", 3)
        first = F.regexp_extract(F.col("position"), r":(\d+)", 1)
        rows = rows.select("*", F.split_part("position", F.lit(":"), F.lit(1)).alias("chr"), first.alias("bp1"), F.when(at != "", at).otherwise(first).alias("bp2")).drop("position")
    return rows.withColumns({"chr": chromosome(F.col("chr")), "bp1": F.col("bp1").cast("long"), "bp2": F.col("bp2").cast("long")})


def reference_variants(spark: SparkSession, path: str, group: str) -> DataFrame:
    """(grp, chr, bp1, bp2, name, meta map) of a table with a `#` header: CHR, BP1 or POS, BP2, ID, and meta-columns."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = rows.withColumnsRenamed({c: c.lstrip("#").upper() for c in rows.columns})
    pick = lambda *names: next((F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    meta = [c for c in rows.columns if c not in ("CHR", "CHROM", "BP1", "POS", "POS1", "BP2", "POS2", "ID")]
    first = pick("BP1", "POS", "POS1").cast("long")
    pairs = F.create_map(*[x for c in meta for x in (F.lit(c), F.col(c))]) if meta else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(group).alias("grp"), chromosome(pick("CHR", "CHROM")).alias("chr"), first.alias("bp1"), F.coalesce(pick("BP2", "POS2").cast("long"), first).alias("bp2"), pick("ID").alias("name"), pairs.alias("meta"))


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(kind1, name1, kind2, name2): both directions of every pair in a row of a wide table with a header."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    rows = rows.withColumnsRenamed({c: c.lstrip("#") for c in rows.columns})
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in rows.columns])
    one = rows.withColumn("x", F.explode(cells)).withColumn("y", F.explode(cells)).where("x.kind <> y.kind and x.name is not null and y.name is not null")
    return one.select(F.col("x.kind").alias("kind1"), F.col("x.name").alias("name1"), F.col("y.kind").alias("kind2"), F.col("y.name").alias("name2")).distinct()


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """(chr, bp1, bp2, seq): the records of a FASTA in chunks of one width; records are split at their mark by the reader."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")
    cut = F.regexp_extract_all("seq", F.lit(f"(.{{1,{chunk}}})"), F.lit(1))
    each = records.select(chromosome(name).alias("chr"), seq.alias("seq")).select("chr", F.posexplode(cut).alias("k", "seq"))
    return each.select("chr", (F.col("k") * chunk + 1).cast("long").alias("bp1"), (F.col("k") * chunk + F.length("seq")).cast("long").alias("bp2"), "seq")


def sequence(chunks: DataFrame, places: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """places (chr, bp1, bp2) with their bases, put together from the chunks they touch."""
    p = places.select("chr", "bp1", "bp2").distinct()
    need = p.withColumn("k", F.explode(F.sequence(F.floor((F.col("bp1") - 1) / chunk), F.floor((F.col("bp2") - 1) / chunk))))
    have = chunks.select("chr", F.floor((F.col("bp1") - 1) / chunk).alias("k"), F.col("bp1").alias("c1"), "seq")
    low = F.greatest(F.col("bp1"), F.col("c1"))
    piece = F.substring("seq", (low - F.col("c1") + 1).cast("int"), (F.least(F.col("bp2"), F.col("c1") + F.length("seq") - 1) - low + 1).cast("int"))
    return need.join(have, ["chr", "k"]).groupBy("chr", "bp1", "bp2").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("s")))), lambda x: x["s"]), "").alias("seq"))


def dosages(spark: SparkSession, path: str, samples: list[str], kind: str = "dose1", within: float = 0.1) -> DataFrame:
    """(name, indiv_id, dosage, ac) of a matrix with a row for each variant; kinds dose1, dose2 (two alleles), prob2, prob3.

    ac is the hard call within a distance of a whole number, or null.
    """
    per = {"dose1": 1, "dose2": 2, "prob2": 2, "prob3": 3}[kind]
    f = F.split(F.trim("value"), r"\s+")
    each = spark.read.text(path).select(f[0].alias("name"), F.transform(F.slice(f, 2, per * len(samples)), lambda x: x.try_cast("double")).alias("v"))
    each = each.select("name", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda k: F.slice(F.col("v"), k * per + 1, F.lit(per)))).alias("k", "v"))
    v = F.col("v")
    dosage = {"dose1": v[0], "dose2": v[1] if per > 1 else None, "prob2": 2 - 2 * v[0] - v[1] if per > 1 else None, "prob3": v[1] + 2 * v[2] if per > 2 else None}[kind]
    from ..functions.alleles import hard_call

    return each.select("name", F.array(*map(F.lit, samples))[F.col("k")].alias("indiv_id"), dosage.alias("dosage")).withColumn("ac", hard_call(F.col("dosage"), within))


def plink(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variants, genotypes, people) of PREFIX.bed, .bim and .fam; the bed is read in records of one variant's bytes."""
    people = delimited(spark, f"{prefix}.fam", "fid string, iid string, pat string, mat string, sex int, phe string")
    ids = [r[0] for r in spark.read.text(f"{prefix}.fam").select(F.split(F.trim("value"), r"\s+")[1]).collect()]  # the people in order
    order = spark.read.text(f"{prefix}.bim").select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("i"))
    names = order.select(chromosome(F.col("f")[0]).alias("chr"), F.col("f")[3].cast("long").alias("bp1"), F.col("f")[1].alias("name"), F.col("f")[4].alias("alt"), F.col("f")[5].alias("ref"), "i").repartition(1).sortWithinPartitions("i")
    variants = names.withColumn("var_id", F.monotonically_increasing_id()).drop("i")
    width = -(-len(ids) // 4)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, body in zip(pdf["start"], pdf["body"]):
                raw = np.frombuffer(body, np.uint8).reshape(-1, width)
                two = ((raw[:, :, None] >> np.array([0, 2, 4, 6])) & 3).reshape(len(raw), -1)[:, : len(ids)]
                v, p = np.nonzero(two != 3)  # 3 is homozygous for the second allele, the reference
                yield pd.DataFrame({"var_id": v + start, "indiv_id": np.array(ids, object)[p], "ac": pd.array(np.array([2, -1, 1, 0])[two[v, p]], "Int64")}).replace({"ac": {-1: None}}).astype({"ac": "Int64"})

    blocks = spark.read.format("binaryFile").load(f"{prefix}.bed").select(F.expr("substring(content, 4)").alias("content"))
    per = max(1, (1 << 20) // width) * width
    cut = blocks.select(F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / per) - 1, F.lit(0)))).alias("b"), "content")
    cut = cut.select((F.col("b") * (per // width)).alias("start"), F.expr(f"substring(content, cast(b * {per} + 1 as int), {per})").alias("body"))
    return variants, cut.mapInPandas(unpacked, "var_id long, indiv_id string, ac int"), people


def network(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, score), each edge in both directions."""
    e = delimited(spark, path, "a string, b string, score double")
    return e.union(e.select("b", "a", "score"))


#: Schemas of the plain tables; read them with delimited().
SCHEMAS = {
    "ibd": "id1 string, id2 string, chr string, bp1 long, bp2 long", "ibd_pheno": "id1 string, id2 string, phe string, chr string, bp1 long, bp2 long", "locset": "name string, set_name string",
    "protein": "transcript string, protein string, source string, feature string, name string, begin int, end int, meta string", "segments": "indiv_id string, chr string, bp1 long, bp2 long", "id_map": "old string, new string",
    "weights": "transcript string, position int, aa1 string, aa2 string, score double", "var_set": "name string, description string", "meta": "name string, key string, value string",
}


def swap_ids(df: DataFrame, names: DataFrame, column: str = "indiv_id") -> DataFrame:
    """df with the ids of (old, new) replaced."""
    return df.join(names.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def protein_on_genome(features: DataFrame, cds: DataFrame) -> DataFrame:
    """Protein features (transcript, begin, end) on the genome: the part of each CDS piece (name, chr, bp1, bp2, strand) that codes for it."""
    from pyspark.sql import Window

    plus = F.col("strand") == "+"
    order = Window.partitionBy("name").orderBy(F.when(plus, F.col("bp1")).otherwise(-F.col("bp1"))).rowsBetween(Window.unboundedPreceding, -1)
    parts = cds.select("name", "chr", "bp1", "bp2", "strand").withColumn("before", F.coalesce(F.sum(F.col("bp2") - F.col("bp1") + 1).over(order), F.lit(0)))
    met = features.join(parts, features["transcript"] == parts["name"]).withColumn("f", (F.col("begin") - 1) * 3).withColumn("t", F.col("end") * 3)
    size = F.col("bp2") - F.col("bp1") + 1
    low, high = F.greatest(F.col("f") - F.col("before"), F.lit(0)), F.least(F.col("t") - F.col("before"), size) - 1
    out = met.where(low <= high)
    return out.select("transcript", "feature", "chr", F.when(plus, F.col("bp1") + low).otherwise(F.col("bp2") - high).alias("bp1"), F.when(plus, F.col("bp1") + high).otherwise(F.col("bp2") - low).alias("bp2"))
