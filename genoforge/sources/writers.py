"""Writers: VCF, PLINK text, likelihoods, haplotypes, phenotypes, and long or wide tables.

Order over a file set comes from range partitioning on (chr, bp1): part files in name order are the whole in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_site(geno: DataFrame, cell) -> DataFrame:
    """(var_id, m): a map from each person with a row to a string."""
    return geno.groupBy("var_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("indiv_id").cast("string"), cell))).alias("m"))


def vcf_lines(variants: DataFrame, geno: DataFrame, people: list[str]) -> DataFrame:
    """(chr, bp1, line) of a VCF; geno (var_id, indiv_id, ac) needs rows of carriers and missing only."""
    gt = F.when(F.col("ac") == 1, "0/1").when(F.col("ac") == 2, "1/1").when(F.col("ac") == 0, "0/0").otherwise("./.")
    known = _by_site(geno, gt)
    cells = F.transform(F.array(*map(F.lit, people)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit("0/0")))
    v = variants.join(known, "var_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    head = [F.col("chr").cast("string"), F.col("bp1").cast("string"), F.col("name"), F.col("ref"), F.col("alt"), F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.col("filter"), F.lit("."), F.lit("GT")]
    return v.select("chr", "bp1", F.concat_ws("\t", *head, cells).alias("line"))


def write_vcf(variants: DataFrame, geno: DataFrame, people: list[str], path: str, compression: str = "none") -> None:
    """A VCF as a folder: header.vcf, then body parts in order."""
    spark = variants.sparkSession
    head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *people])]
    spark.createDataFrame([("\n".join(head),)], "value string").write.text(f"{path}/0-header")
    body = vcf_lines(variants, geno, people).repartitionByRange("chr", "bp1").sortWithinPartitions("chr", "bp1")
    body.select(F.col("line").alias("value")).write.option("compression", compression).text(f"{path}/1-body")


def write_tped(variants: DataFrame, geno: DataFrame, people: list[str], path: str) -> None:
    """PLINK TPED lines in order, with allele letters."""
    pair = F.when(F.col("ac") == 1, "ra").when(F.col("ac") == 2, "aa").when(F.col("ac") == 0, "rr").otherwise("00")
    known = _by_site(geno, pair)
    v = variants.join(known, "var_id", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    letters = lambda x: F.when(x == "ra", F.concat("ref", F.lit(" "), "alt")).when(x == "aa", F.concat("alt", F.lit(" "), "alt")).when(x == "00", "0 0").otherwise(F.concat("ref", F.lit(" "), "ref"))
    cells = F.transform(F.array(*map(F.lit, people)), lambda p: letters(F.coalesce(F.try_element_at("m", p), F.lit("rr"))))
    lines = v.select("chr", "bp1", F.concat_ws(" ", F.col("chr").cast("string"), "name", F.lit("0"), F.col("bp1").cast("string"), cells).alias("value"))
    lines.repartitionByRange("chr", "bp1").sortWithinPartitions("chr", "bp1").select("value").write.text(path)


def likelihood_lines(calls: DataFrame, people: list[str]) -> DataFrame:
    """(var_id, line) of three likelihoods a person from phred-scaled `PL` values; people without any get 1 1 1."""
    three = F.array_join(F.transform(F.split(F.col("gmeta")["PL"], ","), lambda x: F.format_number(F.pow(F.lit(10.0), -x.cast("double") / 10), 6)), " ")
    known = calls.where(F.col("gmeta")["PL"].isNotNull()).groupBy("var_id").agg(F.map_from_entries(F.collect_list(F.struct("indiv_id", three))).alias("m"))
    return known.select("var_id", F.array_join(F.transform(F.array(*map(F.lit, people)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit("1 1 1"))), " ").alias("line"))


def haplotypes(calls: DataFrame, order: DataFrame) -> DataFrame:
    """(indiv_id, hap1, hap2): phased alleles of each person along the sites of order (var_id, place)."""
    gt = F.split(F.col("gt"), "\\|")
    rows = calls.where(F.contains("gt", F.lit("|"))).join(order, "var_id").groupBy("indiv_id").agg(F.array_sort(F.collect_list(F.struct("place", gt[0].alias("a"), gt[1].alias("b")))).alias("x"))
    return rows.select("indiv_id", F.array_join(F.transform("x", lambda s: s["a"]), "").alias("hap1"), F.array_join(F.transform("x", lambda s: s["b"]), "").alias("hap2"))


def write_table(df: DataFrame, path: str, wide_by: tuple[str, str, list] | None = None) -> None:
    """A tab-separated table with a header; wide_by (key column, value column, keys) pivots the long form."""
    if wide_by:
        key, value, keys = wide_by
        df = df.groupBy(*[c for c in df.columns if c not in (key, value)]).pivot(key, keys).agg(F.first(value))
    df.write.option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)


def write_study(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as Parquet; variants in ranges of (chr, bp1), so that a region's rows lie in few row groups."""
    for name, df in tables.items():
        if {"chr", "bp1"} <= set(df.columns):
            df = df.repartitionByRange("chr", "bp1").sortWithinPartitions("chr", "bp1")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
