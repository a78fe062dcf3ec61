"""The study that the driver's star-schema tables stand for, as DataFrames and as SQL views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.study import PIECE, Study, consensus


def study(spark: SparkSession, sf_dir: str) -> Study:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = F.col("p_partkey")
    base = lambda k: F.substring(F.lit("ACGT"), (k % 4 + 1).cast("int"), F.lit(1))
    # Most variants change one base; some are insertions, deletions, changes of two bases, or have a second ALT.
    other = base(key % 4 + 1 + F.col("p_size") % 3)
    ref = F.when(key % 9 == 1, F.concat(base(key), F.lit("CG"))).when(key % 9 == 2, "AC").otherwise(base(key))
    alt = F.when(key % 9 == 0, F.concat(base(key), F.lit("A"))).when(key % 9 == 1, base(key)).when(key % 9 == 2, "GT").when(key % 11 == 0, F.concat(other, F.lit(",TT"))).otherwise(other)
    variants = t("part").select(
        key.alias("var_id"), (key % 22 + 1).cast("int").alias("chr"), (1000 + F.floor(key / 22) * 40 + F.col("p_size")).cast("long").alias("bp1"),
        F.when(key % 10 == 0, ".").otherwise(F.concat(F.lit("rs"), key.cast("string"))).alias("name"), ref.alias("ref"), alt.alias("alt"),
        F.col("p_retailprice").alias("qual"), F.when(F.col("p_type") == "ECONOMY", "LowQual").otherwise("PASS").alias("filter"), F.col("p_size").alias("size"))
    c = F.col("c_custkey")
    indiv = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        c.alias("indiv_id"), (c % 2).cast("int").alias("sex"), F.when(F.col("c_acctbal") >= 4500, 2).otherwise(1).alias("aff"), F.col("c_acctbal").alias("qt"),
        F.col("n_regionkey").alias("strata"), F.col("c_mktsegment").alias("factor"), F.when(c % 3 == 2, c - 2).alias("pat"), F.when(c % 3 == 2, c - 1).alias("mat"))
    # Some variants are rare, some seen in no one or in one file only.
    v = F.col("l_partkey")
    seen = ((v % 4 != 0) | (F.col("o_custkey") % 50 == v % 50)) & (v % 17 != 0) & ((v % 5 != 0) | (F.col("l_linestatus") == "F"))
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).where(seen)
    calls = lines.groupBy(F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("file_id"), F.col("l_partkey").alias("var_id"), F.col("o_custkey").alias("indiv_id")).agg(
        F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("ac"), F.sum("l_quantity").alias("dp"), (F.max("l_discount") * 1000).alias("gq"),
        ((F.max("l_returnflag") == "R") & (F.sum("l_quantity") < 5)).alias("is_null"))
    s = F.col("s_suppkey")
    suppliers = t("supplier")
    start = F.floor(s / 22) * 600
    loci = suppliers.select(s.alias("loc_id"), (F.col("s_nationkey") % 3).cast("int").alias("group_id"), (s % 22 + 1).cast("int").alias("chr"),
        (1000 + start).cast("long").alias("bp1"), (1900 + start).cast("long").alias("bp2"), F.concat(F.lit("GENE"), F.floor(s / 2).cast("string")).alias("altname"))
    sets = suppliers.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        s.alias("loc_id"), F.col("n_name").alias("set_name"), F.col("r_name").alias("superset_name"))
    ref = lambda grp, keep: variants.where(keep).select(F.lit(grp).alias("grp"), "var_id", "chr", "bp1", "name", "alt")
    refs = ref("A", "size <= 10").union(ref("B", "size % 7 = 0"))
    n = suppliers.agg(F.count(F.lit(1)).alias("k"))  # one row
    links = suppliers.crossJoin(F.broadcast(n)).select(s.alias("a"), ((s * 7 + 3) % F.col("k")).alias("b"), (F.col("s_acctbal") / 10000).alias("score")).where("a <> b")
    events = t("events").select("user_id", "event_id", "ts")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(order)
    runs = events.withColumn("new", F.when(gap.isNull() | (F.col("ts") > gap + F.expr("INTERVAL 6 HOUR")), 1).otherwise(0)).withColumn("seg", F.sum("new").over(order))
    segments = runs.groupBy(F.col("user_id").alias("indiv_id"), "seg").agg(F.min("ts").alias("t1"), F.max("ts").alias("t2"), F.count(F.lit(1)).alias("n"))
    pheno = indiv.select("indiv_id", F.explode(F.create_map(F.lit("aff"), F.col("aff").cast("double"), F.lit("qt"), "qt", F.lit("strata"), F.col("strata").cast("double"))).alias("pheno", "value"))
    var_sets = variants.select("var_id", F.concat(F.lit("S"), (F.col("var_id") % 5).cast("string")).alias("set_name"), F.when(F.col("var_id") % 5 < 2, "X").otherwise("Y").alias("superset_name"))
    proteins = loci.select(F.col("altname").alias("transcript"), F.when(F.col("loc_id") % 2 == 0, "PFAM").otherwise("SMART").alias("source"),
        F.concat(F.lit("F"), (F.col("loc_id") % 5).cast("string")).alias("feature"), "chr", (F.col("bp1") + 100).alias("bp1"), (F.col("bp1") + 500).alias("bp2"))
    sites = calls.select("file_id", "var_id").distinct().withColumn("filter", F.when((F.col("var_id") + F.col("file_id")) % 4 == 0, "LowQual").otherwise("PASS"))
    metas = variants.where("var_id % 3 = 0").select("var_id", F.lit("M1").alias("grp"), F.lit("weight").alias("key"), (F.col("size") / 10).cast("string").alias("value"))
    # Each locus is a transcript of three exons, the outer ones coding in part.
    shape = [("exon", 0, 249), ("exon", 350, 600), ("exon", 700, 900), ("CDS", 50, 249), ("CDS", 350, 600), ("CDS", 700, 800)]
    layout = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, a, b in shape])
    transcripts = loci.select(F.concat(F.lit("T"), F.col("loc_id").cast("string")).alias("transcript"), F.col("altname").alias("gene"), "chr", "bp1", F.when(F.col("loc_id") % 4 < 2, "+").otherwise("-").alias("strand"), F.inline(layout)).select(
        "transcript", "gene", "kind", "chr", (F.col("bp1") + F.col("a")).alias("bp1"), (F.col("bp1") + F.col("b")).alias("bp2"), "strand", F.lit(0).alias("frame"))
    places = loci.select("chr", F.explode(F.sequence(F.floor((F.col("bp1") - PIECE) / PIECE), F.floor((F.col("bp2") + PIECE) / PIECE))).alias("piece")).distinct()
    digest = F.sha2(F.concat(F.col("chr").cast("string"), F.lit(":"), F.col("piece").cast("string")), 256)
    reference = places.withColumn("seq", F.translate(digest, "0123456789abcdef", "ACGTACGTACGTACGT"))
    pair = indiv.select("indiv_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).join(indiv.agg(F.max("indiv_id").alias("most")).hint("broadcast"))  # one row
    x, k = F.col("indiv_id"), F.col("k")
    begin = 1000 + (x * 13 + k * 101) % 700
    ibd = pair.select(x.alias("id1"), ((x * (2 * k + 1) + 5 * k) % F.col("most") + 1).alias("id2"), ((x + k) % 22 + 1).cast("int").alias("chr"), begin.alias("bp1"), (begin + 150 + x % 5 * 120).alias("bp2")).where("id1 <> id2")
    return Study(
        transcripts=transcripts, reference=reference, ibd=ibd,
        proteins=proteins, sites=sites, metas=metas, variants=variants, calls=calls, geno=consensus(calls), indiv=indiv, loci=loci, sets=sets, refs=refs, edges=links.union(links.select("b", "a", "score")),
        seqs=t("documents").select("doc_id", F.translate("text", "acgtn", "ACGTN").alias("seq")), segments=segments, pheno=pheno, var_sets=var_sets)


#: The same tables for the SQL side, each a common table expression.
VIEWS = {
    "g_variants": """SELECT p_partkey AS var_id, CAST(p_partkey % 22 + 1 AS INT) AS chr, CAST(1000 + CAST(floor(p_partkey/22.0) AS BIGINT)*40 + p_size AS BIGINT) AS bp1,
 CASE WHEN p_partkey % 10 = 0 THEN '.' ELSE concat('rs', CAST(p_partkey AS VARCHAR)) END AS name, CASE p_partkey%9 WHEN 1 THEN concat(b, 'CG') WHEN 2 THEN 'AC' ELSE b END AS ref,
 CASE p_partkey%9 WHEN 0 THEN concat(b, 'A') WHEN 1 THEN b WHEN 2 THEN 'GT' ELSE CASE WHEN p_partkey%11=0 THEN concat(o, ',TT') ELSE o END END AS alt, p_retailprice AS qual, CASE WHEN p_type='ECONOMY' THEN 'LowQual' ELSE 'PASS' END AS filter, p_size AS size
 FROM (SELECT *, substr('ACGT', CAST(p_partkey%4+1 AS INT), 1) AS b, substr('ACGT', CAST((p_partkey%4+1+p_size%3)%4+1 AS INT), 1) AS o FROM part) p""",
    "g_indiv": """SELECT c_custkey AS indiv_id, CAST(c_custkey%2 AS INT) AS sex, CASE WHEN c_acctbal>=4500 THEN 2 ELSE 1 END AS aff, c_acctbal AS qt, n_regionkey AS strata,
 c_mktsegment AS factor, CASE WHEN c_custkey%3=2 THEN c_custkey-2 END AS pat, CASE WHEN c_custkey%3=2 THEN c_custkey-1 END AS mat FROM customer JOIN nation ON c_nationkey=n_nationkey""",
    "g_calls": """SELECT CASE WHEN l_linestatus='F' THEN 1 ELSE 2 END AS file_id, l_partkey AS var_id, o_custkey AS indiv_id, CAST(least(2,count(*)) AS INT) AS ac, sum(l_quantity) AS dp,
 max(l_discount)*1000 AS gq, (max(l_returnflag)='R' AND sum(l_quantity)<5) AS is_null FROM lineitem JOIN orders ON l_orderkey=o_orderkey
 WHERE (l_partkey%4<>0 OR o_custkey%50=l_partkey%50) AND l_partkey%17<>0 AND (l_partkey%5<>0 OR l_linestatus='F') GROUP BY 1,2,3""",
    "g_geno": """SELECT var_id, indiv_id, CASE WHEN count(DISTINCT CASE WHEN NOT is_null THEN ac END)=1 THEN max(CASE WHEN NOT is_null THEN ac END) END AS ac FROM g_calls GROUP BY 1,2""",
    "g_loci": """SELECT s_suppkey AS loc_id, CAST(s_nationkey%3 AS INT) AS group_id, CAST(s_suppkey%22+1 AS INT) AS chr, CAST(1000+CAST(floor(s_suppkey/22.0) AS BIGINT)*600 AS BIGINT) AS bp1,
 CAST(1900+CAST(floor(s_suppkey/22.0) AS BIGINT)*600 AS BIGINT) AS bp2, concat('GENE',CAST(CAST(floor(s_suppkey/2.0) AS BIGINT) AS VARCHAR)) AS altname FROM supplier""",
    "g_sets": """SELECT s_suppkey AS loc_id, n_name AS set_name, r_name AS superset_name FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "g_ref": """SELECT 'A' AS grp, var_id, chr, bp1, name, alt FROM g_variants WHERE size<=10 UNION ALL SELECT 'B' AS grp, var_id, chr, bp1, name, alt FROM g_variants WHERE size%7=0""",
    "g_edges": """SELECT a, b, score FROM (SELECT s_suppkey AS a, (s_suppkey*7+3) % (SELECT count(*) FROM supplier) AS b, s_acctbal/10000 AS score FROM supplier) e WHERE a<>b
 UNION ALL SELECT b AS a, a AS b, score FROM (SELECT s_suppkey AS a, (s_suppkey*7+3) % (SELECT count(*) FROM supplier) AS b, s_acctbal/10000 AS score FROM supplier) f WHERE a<>b""",
    "g_seq": """SELECT doc_id, translate(text, 'acgtn', 'ACGTN') AS seq FROM documents""",
    "g_segments": """SELECT user_id AS indiv_id, seg, min(ts) AS t1, max(ts) AS t2, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) x) y GROUP BY 1,2""",
    "g_pheno": """SELECT indiv_id, 'aff' AS pheno, CAST(aff AS DOUBLE) AS value FROM g_indiv UNION ALL SELECT indiv_id, 'qt' AS pheno, qt AS value FROM g_indiv
 UNION ALL SELECT indiv_id, 'strata' AS pheno, CAST(strata AS DOUBLE) AS value FROM g_indiv""",
    "g_varsets": """SELECT var_id, concat('S', CAST(var_id%5 AS VARCHAR)) AS set_name, CASE WHEN var_id%5<2 THEN 'X' ELSE 'Y' END AS superset_name FROM g_variants""",
    "g_prot": """SELECT altname AS transcript, CASE WHEN loc_id%2=0 THEN 'PFAM' ELSE 'SMART' END AS source, concat('F', CAST(loc_id%5 AS VARCHAR)) AS feature, chr, bp1+100 AS bp1, bp1+500 AS bp2 FROM g_loci""",
    "g_sites": """SELECT DISTINCT file_id, var_id, CASE WHEN (var_id+file_id)%4=0 THEN 'LowQual' ELSE 'PASS' END AS filter FROM g_calls""",
    "g_genome": """SELECT loc_id, altname, chr, bp1 AS b, loc_id%4>=2 AS minus, 64*CAST(floor((bp1-64)/64.0) AS BIGINT) AS s0,
 (SELECT string_agg(translate(sha256(concat(CAST(chr AS VARCHAR), ':', CAST(p AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p)
  FROM unnest(range(CAST(floor((bp1-64)/64.0) AS BIGINT), CAST(floor((bp2+64)/64.0) AS BIGINT)+1)) u(p)) AS g FROM g_loci""",
    "g_ibd": """SELECT indiv_id AS id1, (indiv_id*(2*k+1)+5*k)%most+1 AS id2, CAST((indiv_id+k)%22+1 AS INT) AS chr, 1000+(indiv_id*13+k*101)%700 AS bp1, 1000+(indiv_id*13+k*101)%700+150+indiv_id%5*120 AS bp2
 FROM (SELECT i.indiv_id, k, m.most FROM g_indiv i, range(1, 5) r(k), (SELECT max(indiv_id) AS most FROM g_indiv) m) x WHERE indiv_id <> (indiv_id*(2*k+1)+5*k)%most+1""",
    "g_ibd2": """SELECT id1 AS indiv_id, id2 AS partner, chr, bp1, bp2 FROM g_ibd UNION SELECT id2, id1, chr, bp1, bp2 FROM g_ibd""",
    "n": """SELECT count(*) AS n, count(*) FILTER (aff=2) AS na, count(*) FILTER (aff=1) AS nu FROM g_indiv""",
    "c": """SELECT g.var_id, count(*) FILTER (ac=1) AS het, count(*) FILTER (ac=2) AS hom, count(*) FILTER (ac IS NULL) AS nul,
 count(*) FILTER (ac=1 AND aff=2) AS a_het, count(*) FILTER (ac=2 AND aff=2) AS a_hom, count(*) FILTER (ac IS NULL AND aff=2) AS a_nul,
 count(*) FILTER (ac=1 AND aff=1) AS u_het, count(*) FILTER (ac=2 AND aff=1) AS u_hom, count(*) FILTER (ac IS NULL AND aff=1) AS u_nul FROM g_geno g JOIN g_indiv i USING (indiv_id) GROUP BY 1""",
    "vc0": """SELECT v.*, coalesce(het,0) het, coalesce(hom,0) hom, coalesce(nul,0) nul, coalesce(a_het,0) a_het, coalesce(a_hom,0) a_hom, coalesce(a_nul,0) a_nul,
 coalesce(u_het,0) u_het, coalesce(u_hom,0) u_hom, coalesce(u_nul,0) u_nul, n.* FROM g_variants v LEFT JOIN c USING (var_id) CROSS JOIN n""",
    "vc1": """SELECT *, het+2*hom AS ac, 2*(n-nul) AS tot, n-nul-het-hom AS rr, a_het+2*a_hom AS a_ac, 2*(na-a_nul) AS a_tot, na-a_nul-a_het-a_hom AS a_rr,
 u_het+2*u_hom AS u_ac, 2*(nu-u_nul) AS u_tot, nu-u_nul-u_het-u_hom AS u_rr FROM vc0""",
    "vc2": """SELECT *, CASE WHEN tot>0 THEN ac/CAST(tot AS DOUBLE) END AS aaf FROM vc1""",
    "vc": """SELECT *, coalesce(aaf>0.5, false) AS flip, CASE WHEN aaf>0.5 THEN tot-ac ELSE ac END AS mac, CASE WHEN aaf>0.5 THEN 1-aaf ELSE aaf END AS maf FROM vc2""",
    "vl": """SELECT l.*, v.var_id, v.bp1 AS pos FROM g_variants v JOIN g_loci l ON v.chr=l.chr AND v.bp1 BETWEEN l.bp1 AND l.bp2""",
    "hw": """SELECT het, hom, rr, CASE WHEN het+hom+rr=0 THEN 1.0 ELSE least(1.0, list_sum(list_filter(p, lambda x: x <= p0*(1+1e-7)))) END AS hwe FROM (
 SELECT het, hom, rr, list_transform(range(k%2, k+1, 2), lambda h: exp(h*ln(2)+lf_n-lgamma(h+1)-lgamma((k-h)//2+1)-lgamma(nn-h-(k-h)//2+1)+lgamma(k+1)+lgamma(2*nn-k+1)-lgamma(2*nn+1))) AS p,
 exp(het*ln(2)+lf_n-lgamma(het+1)-lgamma(hom+1)-lgamma(rr+1)+lgamma(k+1)+lgamma(2*nn-k+1)-lgamma(2*nn+1)) AS p0 FROM (
 SELECT het, hom, rr, het+hom+rr AS nn, 2*least(hom,rr)+het AS k, lgamma(het+hom+rr+1) AS lf_n FROM (SELECT DISTINCT het, hom, rr FROM vc)) q) r""",
}


def sql(body: str) -> str:
    """body with the views before it; rounding leans upwards as in summaries.rounded()."""
    body = body.replace("round(", "round(1e-9+")
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in VIEWS.items()) + "\n" + body
