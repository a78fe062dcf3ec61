"""Records of three overlapping files that the driver's tables stand for: indels, several ALTs, sex chromosomes, dosages, likelihoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Records:
    """sites (site_id, file_id, chr, bp1, ref, alt), genotypes (site_id, indiv_id, a1, a2, dosage, l0, l1, l2), members (file_id, indiv_id), indiv (indiv_id, sex)."""

    sites: DataFrame
    genotypes: DataFrame
    members: DataFrame
    indiv: DataFrame


def records(spark: SparkSession, sf_dir: str) -> Records:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    p, f = F.col("p_partkey"), F.col("f")
    base = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    kind = p % 6
    ref = F.when(kind == 1, F.concat(base(p), base(p + 1), base(p + 2), base(p + 3))).when(kind == 2, F.concat(base(p), base(p + 1))).otherwise(base(p))
    alt = (
        F.when(kind == 0, F.concat(base(p), F.lit("AC"))).when(kind == 1, base(p)).when(kind == 2, F.concat(base(p + 1), base(p + 2)))
        .when(kind == 3, F.concat(base(p + 1), F.lit(","), base(p + 2))).when(kind == 4, base(p + f)).otherwise(F.when(f <= 2, base(p + 1)).otherwise(F.concat(base(p), F.lit("T"))))
    )
    files = t("part").select("p_partkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("f")).where((p + f) % 3 != 0)
    sites = files.select((p * 4 + f).alias("site_id"), f.alias("file_id"), (p % 24 + 1).cast("int").alias("chr"), (1000 + F.floor(p / 24) * 3).cast("long").alias("bp1"), ref.alias("ref"), alt.alias("alt"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    site = F.col("l_partkey") * 4 + F.col("l_linenumber") % 3 + 1
    each = lines.groupBy(site.alias("site_id"), F.col("o_custkey").alias("indiv_id")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("x"))
    alts = F.when(F.floor(F.col("site_id") / 4) % 6 == 3, 2).otherwise(1)
    a1, a2 = F.when(F.col("q") > 25, 1).otherwise(0), 1 + F.col("indiv_id") % alts
    known = F.col("q") > 2
    called = each.join(sites.select("site_id"), "site_id", "left_semi")
    genotypes = called.select("site_id", "indiv_id", F.when(known, a1).cast("int").alias("a1"), F.when(known, a2).cast("int").alias("a2"), (F.col("d") * 20).alias("dosage"),
        (0.05 + F.col("x") * 10).alias("l0"), (0.05 + F.col("d") * 8).alias("l1"), (0.05 + (F.col("q") % 10) / 20).alias("l2"))
    c = F.col("c_custkey")
    indiv = t("customer").select(c.alias("indiv_id"), (c % 2).cast("int").alias("sex"))
    members = indiv.select(F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("file_id"), "indiv_id").where((F.col("indiv_id") + F.col("file_id")) % 4 != 0)
    return Records(sites, genotypes, members, indiv)


_base = "substr('ACGT', CAST(({})%4+1 AS INT), 1)".format
#: The same tables for the SQL side.
VIEWS = {
    "r_sites": f"""SELECT p*4+f AS site_id, f AS file_id, CAST(p%24+1 AS INT) AS chr, CAST(1000+CAST(floor(p/24.0) AS BIGINT)*3 AS BIGINT) AS bp1,
 CASE p%6 WHEN 1 THEN concat({_base("p")},{_base("p+1")},{_base("p+2")},{_base("p+3")}) WHEN 2 THEN concat({_base("p")},{_base("p+1")}) ELSE {_base("p")} END AS ref,
 CASE p%6 WHEN 0 THEN concat({_base("p")},'AC') WHEN 1 THEN {_base("p")} WHEN 2 THEN concat({_base("p+1")},{_base("p+2")}) WHEN 3 THEN concat({_base("p+1")},',',{_base("p+2")})
  WHEN 4 THEN {_base("p+f")} ELSE CASE WHEN f<=2 THEN {_base("p+1")} ELSE concat({_base("p")},'T') END END AS alt
 FROM (SELECT p_partkey AS p, unnest([1,2,3]) AS f FROM part) x WHERE (p+f)%3<>0""",
    "r_geno": """SELECT site_id, indiv_id, CAST(CASE WHEN q>2 THEN CASE WHEN q>25 THEN 1 ELSE 0 END END AS INT) AS a1,
 CAST(CASE WHEN q>2 THEN 1+indiv_id%(CASE WHEN CAST(floor(site_id/4.0) AS BIGINT)%6=3 THEN 2 ELSE 1 END) END AS INT) AS a2, d*20 AS dosage, 0.05+x*10 AS l0, 0.05+d*8 AS l1, 0.05+(q%10)/20 AS l2
 FROM (SELECT l_partkey*4+l_linenumber%3+1 AS site_id, o_custkey AS indiv_id, max(l_quantity) AS q, max(l_discount) AS d, max(l_tax) AS x FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2) e
 WHERE site_id IN (SELECT site_id FROM r_sites)""",
    "r_indiv": "SELECT c_custkey AS indiv_id, CAST(c_custkey%2 AS INT) AS sex FROM customer",
    "r_members": "SELECT file_id, indiv_id FROM (SELECT c_custkey AS indiv_id, unnest([1,2,3]) AS file_id FROM customer) m WHERE (indiv_id+file_id)%4<>0",
    "r_exact": """SELECT *, min(site_id) OVER (PARTITION BY chr, bp1, bp2, kind) AS var_id FROM (SELECT *, bp1+length(ref)-1 AS bp2, string_split(alt, ',') AS alts,
 CASE WHEN len(list_distinct(list_transform(string_split(alt,','), lambda a: length(a))))=1 THEN CAST(length(string_split(alt,',')[1]) AS VARCHAR) ELSE alt END AS kind FROM r_sites) s""",
    "r_none": "SELECT *, bp1+length(ref)-1 AS bp2, string_split(alt, ',') AS alts, min(site_id) OVER (PARTITION BY chr, bp1, ref, alt) AS var_id FROM r_sites",
    "r_any": """SELECT s.*, string_split(alt, ',') AS alts, min(site_id) OVER (PARTITION BY chr, island) AS var_id FROM (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY bp1 RANGE UNBOUNDED PRECEDING) AS island FROM (
 SELECT s.*, CASE WHEN k.before>=s.bp1 OR s.site_id<>k.first THEN 0 ELSE 1 END AS fresh FROM (SELECT *, bp1+length(ref)-1 AS bp2 FROM r_sites) s
 JOIN (SELECT chr, bp1, min(site_id) AS first, max(max(bp1+length(ref)-1)) OVER (PARTITION BY chr ORDER BY bp1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r_sites GROUP BY 1,2) k USING (chr, bp1)) f) s""",
}


def sql(body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + "\n" + body.replace("round(", "round(1e-9+")
