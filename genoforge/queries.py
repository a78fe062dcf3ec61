"""Queries by name over the study that the star-schema tables stand for, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .annotation_sql import annotation
from .operators import annotation as N
from .operators import association as A
from .operators import family as Y
from .operators import genes as E
from .operators import loci as L
from .operators import network as W
from .operators import sharing as H
from .operators import summaries as S
from .operators import views as V
from .plans import genotypes as G
from .plans import merge as M
from .plans.mask import mask
from .plans.study import Study
from .sources import bcf as B
from .sources import records as R
from .sources.projection import sql, study
from .sources.scratch import fresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: What each query makes of a study, for studies that were written before.
MAKE: dict[str, Callable[[Study], DataFrame]] = {}


def query(name: str, make: Callable[[Study], DataFrame], body: str | None = None) -> None:
    MAKE[name] = lambda s: S.rounded(make(s))
    QUERIES[name] = lambda spark, sf_dir: MAKE[name](study(spark, sf_dir))
    if body:
        SQL[name] = sql(body)


TI = "concat(least(ref,alt),greatest(ref,alt)) IN ('AG','CT')"
TV = "concat(least(ref,alt),greatest(ref,alt)) IN ('AC','AT','CG','GT')"

query("counts_by_locus", lambda s: S.counts_by_locus(s, 1, 0.05), """SELECT l.loc_id, v.var_id, v.chr, v.bp1, a_ac AS a_alt, u_ac AS u_alt, a_tot, u_tot
 FROM vc v JOIN g_loci l ON v.chr=l.chr AND v.bp1 BETWEEN l.bp1 AND l.bp2 WHERE l.group_id=1 AND v.filter='PASS' AND aaf BETWEEN 0 AND 0.05""")
query("v_freq", S.v_freq, f"""SELECT v.var_id, v.chr, v.bp1, ref, alt, filter, round(qual,6) AS qual, {TI} AS ti, round(1-nul/CAST(n AS DOUBLE),6) AS geno, mac, round(maf,6) AS maf, flip AS refmin,
 round(hwe,6) AS hwe, round(v.het/CAST(n-nul AS DOUBLE),6) AS het, nsnp FROM vc v JOIN hw ON v.het=hw.het AND v.hom=hw.hom AND v.rr=hw.rr
 JOIN (SELECT chr, bp1, count(*) OVER (PARTITION BY chr ORDER BY bp1 RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING)-1 AS nsnp FROM (SELECT DISTINCT chr, bp1 FROM g_variants) d) k ON v.chr=k.chr AND v.bp1=k.bp1""")
query("counts", S.counts, """SELECT var_id, ref, alt, CASE WHEN flip THEN ref ELSE alt END AS minor, CASE WHEN flip THEN a_tot-a_ac ELSE a_ac END AS cnta,
 CASE WHEN flip THEN u_tot-u_ac ELSE u_ac END AS cntu, a_tot AS tota, u_tot AS totu FROM vc""")
query("g_counts", S.g_counts, """SELECT var_id, ref, alt, concat_ws(' ', concat(ref,'/',ref,'=',a_rr,':',u_rr), concat(ref,'/',alt,'=',a_het,':',u_het),
 concat(alt,'/',alt,'=',a_hom,':',u_hom), concat('./.=',a_nul,':',u_nul)) AS genotypes FROM vc""")
query("means", S.means, """SELECT var_id, ref, alt, round(refmean,6) AS refmean, round(refvar,6) AS refvar, round(sqrt(refvar),6) AS refsd, CAST(refn AS BIGINT) AS refn,
 round(altmean,6) AS altmean, round(altvar,6) AS altvar, round(sqrt(greatest(altvar,0)),6) AS altsd, CAST(altn AS BIGINT) AS altn FROM (
 SELECT var_id, ref, alt, n-ok AS refn, (t-os)/(n-ok) AS refmean, ((t2-os2)-(t-os)*(t-os)/(n-ok))/(n-ok-1) AS refvar, k AS altn, CASE WHEN k>0 THEN s/k END AS altmean, CASE WHEN k>1 THEN (s2-s*s/k)/(k-1) END AS altvar
 FROM (SELECT v.var_id, v.ref, v.alt, coalesce(k,0) AS k, coalesce(s,0) AS s, coalesce(s2,0) AS s2, coalesce(ok,0) AS ok, coalesce(os,0) AS os, coalesce(os2,0) AS os2 FROM g_variants v LEFT JOIN (
 SELECT var_id, count(*) FILTER (ac>0) AS k, sum(qt) FILTER (ac>0) AS s, sum(qt*qt) FILTER (ac>0) AS s2, count(*) FILTER (ac IS NULL OR ac>0) AS ok, sum(qt) FILTER (ac IS NULL OR ac>0) AS os,
 sum(qt*qt) FILTER (ac IS NULL OR ac>0) AS os2 FROM g_geno JOIN g_indiv USING (indiv_id) GROUP BY 1) g USING (var_id)) x
 CROSS JOIN (SELECT CAST(count(qt) AS DOUBLE) AS n, sum(qt) AS t, sum(qt*qt) AS t2 FROM g_indiv) e) y""")

_STATS = f"""count(*) AS nvar, round(avg(1-nul/CAST(n AS DOUBLE)),6) AS rate, round(avg(mac),6) AS mac, round(avg(maf),6) AS maf, count(*) FILTER (mac=1) AS sing, count(*) FILTER (ac=0 OR ac=tot) AS mono,
 round(CASE WHEN count(*) FILTER ({TV})>0 THEN count(*) FILTER ({TI})/CAST(count(*) FILTER ({TV}) AS DOUBLE) END,6) AS titv, round(avg(qual),6) AS qual, round(avg(CASE WHEN filter='PASS' THEN 1.0 ELSE 0.0 END),6) AS pass"""
query("v_stats", S.v_stats, f"""SELECT {_STATS}, round(CASE WHEN count(*) FILTER ({TV} AND mac=1)>0 THEN count(*) FILTER ({TI} AND mac=1)/CAST(count(*) FILTER ({TV} AND mac=1) AS DOUBLE) END,6) AS titv_s,
 round(CASE WHEN count(*) FILTER (mac=1)>0 THEN count(*) FILTER (filter='PASS' AND mac=1)/CAST(count(*) FILTER (mac=1) AS DOUBLE) END,6) AS pass_s FROM vc""")
query("g_stats", S.g_stats, f"""SELECT l.loc_id, l.altname AS name, round((l.bp2-l.bp1+1)/1000.0,6) AS kb, round((l.bp2-l.bp1+1)/CAST(count(*) AS DOUBLE),6) AS dens, {_STATS}
 FROM vc v JOIN g_loci l ON v.chr=l.chr AND v.bp1 BETWEEN l.bp1 AND l.bp2 GROUP BY l.loc_id, l.altname, l.bp1, l.bp2""")
query("i_stats", S.i_stats, """SELECT i.indiv_id, i.aff, count(*) FILTER (g.ac>0) AS nalt, count(*) FILTER (g.ac=1) AS nhet, count(*) FILTER (g.var_id IS NOT NULL AND g.ac IS NULL) AS nmiss, count(*) FILTER (g.ac>0 AND mac=1) AS sing,
 round(avg(maf) FILTER (CASE WHEN flip THEN g.var_id IS NULL OR g.ac<2 ELSE g.ac>0 END),6) AS maf, round(avg(qual) FILTER (CASE WHEN flip THEN g.var_id IS NULL OR g.ac<2 ELSE g.ac>0 END),6) AS qual
 FROM g_indiv i CROSS JOIN vc v LEFT JOIN g_geno g ON g.var_id=v.var_id AND g.indiv_id=i.indiv_id GROUP BY 1,2""")
query("v_dist", S.v_dist, """, grp AS (SELECT indiv_id, aff, 'all' AS stratum FROM g_indiv UNION ALL SELECT indiv_id, aff, CAST(strata AS VARCHAR) FROM g_indiv),
 p AS (SELECT stratum, avg(CASE WHEN aff=2 THEN 1.0 ELSE 0.0 END) AS p FROM grp GROUP BY 1),
 seen AS (SELECT stratum, var_id, CAST(sum(ac) AS BIGINT) AS k, CAST(sum(CASE WHEN aff=2 THEN ac ELSE 0 END) AS BIGINT) AS j FROM g_geno JOIN grp USING (indiv_id) WHERE ac>0 GROUP BY 1,2),
 cells AS (SELECT stratum, k, j, count(*) AS observed FROM seen WHERE k BETWEEN 1 AND 4 GROUP BY 1,2,3),
 grid AS (SELECT stratum, k, nk, unnest(range(0, k+1)) AS j FROM (SELECT stratum, k, sum(observed) AS nk FROM cells GROUP BY 1,2) t),
 e AS (SELECT g.stratum, g.k, g.j, coalesce(observed,0) AS observed, factorial(CAST(g.k AS INT))/(factorial(CAST(g.j AS INT))*factorial(CAST(g.k-g.j AS INT)))*pow(p,g.j)*pow(1-p,g.k-g.j)*nk AS expected
 FROM grid g LEFT JOIN cells c ON g.stratum=c.stratum AND g.k=c.k AND g.j=c.j JOIN p ON g.stratum=p.stratum)
 SELECT stratum, k, j, observed, round(expected,6) AS expected, round(CASE WHEN expected>0 THEN pow(observed-expected,2)/expected ELSE 0 END,6) AS chi2 FROM e""".replace(", grp", "SELECT * FROM (WITH grp", 1) + ")")
query("unique", S.unique, """SELECT * FROM (SELECT var_id, CASE WHEN flip THEN a_rr+a_het ELSE a_het+a_hom END AS in_group, CASE WHEN flip THEN u_rr+u_het ELSE u_het+u_hom END AS outside FROM vc) x WHERE in_group>=2 AND outside<=0""")
query("group_comparison", S.group_comparison, """SELECT groups, count(*) AS n FROM (SELECT var_id, string_agg(CAST(strata AS VARCHAR), ',' ORDER BY strata) AS groups FROM (
 SELECT DISTINCT v.var_id, i.strata FROM vc v CROSS JOIN g_indiv i LEFT JOIN g_geno g ON g.var_id=v.var_id AND g.indiv_id=i.indiv_id WHERE CASE WHEN flip THEN g.var_id IS NULL OR g.ac<2 ELSE g.ac>0 END) d GROUP BY 1) e GROUP BY 1""")
query("clusters", S.clusters, """SELECT loc_id, indiv_id, k, round(mean,6) AS mean, round(sd,6) AS sd FROM (SELECT *, avg(k) OVER (PARTITION BY loc_id) AS mean, stddev_pop(k) OVER (PARTITION BY loc_id) AS sd FROM
 (SELECT loc_id, indiv_id, count(*) AS k FROM vl JOIN g_geno g ON vl.var_id=g.var_id WHERE ac>0 GROUP BY 1,2) a) b WHERE k>mean+5*sd""")
query("i_pop", S.i_pop, """SELECT indiv_id, strata AS pop, nvar, round(exp(ll-m)/sum(exp(ll-m)) OVER (PARTITION BY indiv_id),6) AS prob FROM (SELECT *, max(ll) OVER (PARTITION BY indiv_id) AS m FROM (
 SELECT i.indiv_id, p.strata, sum(CASE WHEN g.var_id IS NULL OR g.ac=0 THEN 2*ln(1-f) WHEN g.ac=1 THEN ln(2*f*(1-f)) WHEN g.ac=2 THEN 2*ln(f) ELSE 0 END) AS ll, count(*) FILTER (g.var_id IS NULL OR g.ac IS NOT NULL) AS nvar FROM g_indiv i CROSS JOIN (
 SELECT v.var_id, s.strata, (coalesce(c.ac,0)+0.5)/CAST(2*s.n+1 AS DOUBLE) AS f FROM g_variants v CROSS JOIN (SELECT strata, count(*) AS n FROM g_indiv GROUP BY 1) s
 LEFT JOIN (SELECT var_id, strata, sum(ac) AS ac FROM g_geno JOIN g_indiv USING (indiv_id) WHERE ac>0 GROUP BY 1,2) c ON v.var_id=c.var_id AND s.strata=c.strata) p
 LEFT JOIN g_geno g ON g.var_id=p.var_id AND g.indiv_id=i.indiv_id GROUP BY 1,2) q) r""")

_ALTS = "len(list_filter(string_split(alt,','), lambda a: {}))"
_SNP = _ALTS.format("NOT (length(ref)=1 AND length(a)=1 AND a<>ref)") + "=0"
_INDEL, _MNP = _ALTS.format("length(a)<>length(ref)") + ">0", _ALTS.format("length(ref)>1 AND length(a)=length(ref) AND a<>ref") + ">0"
#: One base, an indel with its last base, an indel without it, and a chromosome, which is no exact region.
_EXACT = ["chr1:1058", "chr11:1008..1010", "chr12:1038..1040", "chr3"]


def _exact(regions: list[str]) -> str:
    """Exact regions as SQL: a variant's chromosome, first and last base."""
    parts = [(name.removeprefix("chr"), *(span.split("..") * 2)[:2]) for name, _, span in (r.partition(":") for r in regions) if span]
    return " OR ".join(f"(chr={c} AND bp1={a} AND bp1+length(ref)-1={b})" for c, a, b in parts)


#: One query for each mask term, with the term's condition in SQL.
MASKS = {
    "mac": ({"mac": "20:28"}, "mac BETWEEN 20 AND 28"), "maf": ({"maf": "0.002:0.01"}, "maf BETWEEN 0.002 AND 0.01"), "aac": ({"aac": "2:"}, "ac>=2"), "aaf": ({"aaf": "0.01:1"}, "aaf BETWEEN 0.01 AND 1"),
    "monomorphic": ({"monomorphic": True}, "tot>0 AND (ac=0 OR ac=tot)"), "monomorphic_ex": ({"monomorphic.ex": True}, "NOT (tot>0 AND (ac=0 OR ac=tot))"),
    "hwe": ({"hwe": "0.05"}, "(SELECT hwe FROM hw WHERE hw.het=v.het AND hw.hom=v.hom AND hw.rr=v.rr)>=0.05"), "null": ({"null": "1:2"}, "nul BETWEEN 1 AND 2"), "null_prop": ({"null.prop": "0.001"}, "nul/CAST(n AS DOUBLE)<=0.001"),
    "qual": ({"qual": "920:950"}, "qual BETWEEN 920 AND 950"), "filter": ({"filter": ["LowQual"]}, "filter='LowQual'"), "filter_ex": ({"filter.ex": ["LowQual"]}, "filter<>'LowQual'"), "filter_req": ({"filter.req": ["PASS"]}, "filter='PASS'"),
    "any_filter": ({"any.filter": True}, "filter<>'PASS'"), "any_filter_ex": ({"any.filter.ex": True}, "filter='PASS'"),
    "snp": ({"snp": True}, _SNP), "snp_ex": ({"snp.ex": True}, f"NOT ({_SNP})"), "indel": ({"indel": True}, _INDEL), "indel_ex": ({"indel.ex": True}, f"NOT ({_INDEL})"), "mnp": ({"mnp": True}, _MNP), "mnp_ex": ({"mnp.ex": True}, f"NOT ({_MNP})"),
    "biallelic": ({"biallelic": True}, "alt NOT LIKE '%,%'"), "biallelic_ex": ({"biallelic.ex": True}, "alt LIKE '%,%'"), "allele": ({"allele": ["A/G", "C/*"]}, "(ref='A' AND alt='G') OR ref='C'"), "allele_ex": ({"allele.ex": ["A/G"]}, "NOT (ref='A' AND alt='G')"),
    "novel": ({"novel": True}, "name='.'"), "novel_ex": ({"novel.ex": True}, "name<>'.'"), "include": ({"include": "qual > 930 AND size % 2 = 0"}, "qual>930 AND size%2=0"), "meta": ({"meta": ["size:gt:40", "qual:lt:950"]}, "size>40 OR qual<950"), "meta_req": ({"meta.req": ["size:gt:10", "qual:lt:1450"]}, "size>10 AND qual<1450"),
    "reg": ({"reg": ["chr1:1000..2000", "chr5"]}, "(chr=1 AND bp1 BETWEEN 1000 AND 2000) OR chr=5"), "reg_ex": ({"reg.ex": ["chr5"]}, "chr<>5"), "reg_req": ({"reg.req": ["chr2", "chr2:1500+400"]}, "chr=2 AND bp1 BETWEEN 1100 AND 1900"),
    "id": ({"id": ["rs7", "rs12"]}, "name IN ('rs7','rs12')"), "id_ex": ({"id.ex": ["rs7"]}, "name<>'rs7'"),
    "loc": ({"loc": [1]}, "var_id IN (SELECT var_id FROM vl WHERE group_id=1)"), "loc_ex": ({"loc.ex": [1]}, "var_id NOT IN (SELECT var_id FROM vl WHERE group_id=1)"), "loc_req": ({"loc.req": [0, 2]}, "var_id IN (SELECT var_id FROM vl WHERE group_id=0) AND var_id IN (SELECT var_id FROM vl WHERE group_id=2)"),
    "loc_subset": ({"loc": [0, 1, 2], "loc.subset": ["GENE3", "GENE4"]}, "var_id IN (SELECT var_id FROM vl WHERE altname IN ('GENE3','GENE4'))"), "gene": ({"gene": ["GENE5"]}, "var_id IN (SELECT var_id FROM vl WHERE altname='GENE5')"),
    "locset": ({"locset": ["NATION_3", "NATION_7"]}, "var_id IN (SELECT var_id FROM vl JOIN g_sets USING (loc_id) WHERE set_name IN ('NATION_3','NATION_7'))"),
    "ref": ({"ref": ["A"]}, "EXISTS (SELECT 1 FROM g_ref r WHERE r.grp='A' AND r.chr=v.chr AND r.bp1=v.bp1)"), "ref_ex": ({"ref.ex": ["A"]}, "NOT EXISTS (SELECT 1 FROM g_ref r WHERE r.grp='A' AND r.chr=v.chr AND r.bp1=v.bp1)"), "ref_req": ({"ref.req": ["A", "B"]}, "EXISTS (SELECT 1 FROM g_ref r WHERE r.grp='A' AND r.chr=v.chr AND r.bp1=v.bp1) AND EXISTS (SELECT 1 FROM g_ref r WHERE r.grp='B' AND r.chr=v.chr AND r.bp1=v.bp1)"),
    "ref_allelic": ({"ref": ["B"], "ref.allelic": True}, "EXISTS (SELECT 1 FROM g_ref r WHERE r.grp='B' AND r.chr=v.chr AND r.bp1=v.bp1 AND r.alt=v.alt)"),
    "var": ({"var": ["S1"]}, "var_id%5=1"), "var_ex": ({"var.ex": ["S1", "S2"]}, "var_id%5 NOT IN (1,2)"), "varset": ({"varset": ["X"]}, "var_id%5<2"), "varset_ex": ({"varset.ex": ["X"]}, "var_id%5>=2"),
    "case_control": ({"case.control": ["1:2", "0"]}, "least(a_ac,a_tot-a_ac) BETWEEN 1 AND 2 AND least(u_ac,u_tot-u_ac)=0"), "case_uniq": ({"case.uniq": True}, "least(a_ac,a_tot-a_ac)>=1 AND least(u_ac,u_tot-u_ac)=0"), "control_uniq": ({"control.uniq": True}, "least(a_ac,a_tot-a_ac)=0 AND least(u_ac,u_tot-u_ac)>=1"),
    "obs_nfile": ({"obs.nfile": "2"}, "(SELECT count(DISTINCT file_id) FROM g_calls k WHERE k.var_id=v.var_id)>=2"), "alt_file_ex": ({"alt.file.ex": [1]}, "var_id IN (SELECT var_id FROM g_calls GROUP BY 1 HAVING count(*) FILTER (file_id=1 AND NOT is_null AND ac>0)=0)"),
    "ereg": ({"ereg": _EXACT}, _exact(_EXACT)), "ereg_ex": ({"ereg.ex": _EXACT}, f"NOT ({_exact(_EXACT)})"), "ereg_req": ({"ereg.req": ["chr21:1050..1051"]}, _exact(["chr21:1050..1051"])),
    "fail_nfile": ({"fail.nfile": "0:2"}, "var_id IN (SELECT var_id FROM g_sites GROUP BY 1 HAVING count(*) FILTER (filter<>'PASS')=0 AND count(*) FILTER (filter='PASS')>=2)"), "fail_single_file": ({"fail.single.file": True}, "var_id NOT IN (SELECT var_id FROM g_sites WHERE filter<>'PASS')"),
    "meta_attach": ({"meta.attach": ["M1"], "include": "CAST(attached['weight'] AS DOUBLE) > 2"}, "var_id%3=0 AND size/10.0>2"), "alt_group": ({"alt.group": ["x"], "qual": "920:950"}, "qual BETWEEN 920 AND 950"),
    "obs_file": ({"obs.file": [1]}, "var_id IN (SELECT var_id FROM g_calls WHERE file_id=1)"), "obs_file_req": ({"obs.file.req": [1, 2]}, "var_id IN (SELECT var_id FROM g_calls WHERE file_id=1) AND var_id IN (SELECT var_id FROM g_calls WHERE file_id=2)"), "obs_file_ex": ({"obs.file.ex": [2]}, "var_id IN (SELECT var_id FROM g_calls) AND var_id NOT IN (SELECT var_id FROM g_calls WHERE file_id=2)"),
    "alt_nfile": ({"alt.nfile": "2"}, "(SELECT count(DISTINCT file_id) FROM g_calls k WHERE k.var_id=v.var_id AND NOT is_null AND ac>0)>=2"), "alt_file": ({"alt.file": [1]}, "var_id IN (SELECT var_id FROM g_calls WHERE file_id=1 AND NOT is_null AND ac>0)"), "alt_file_req": ({"alt.file.req": [1, 2]}, "var_id IN (SELECT var_id FROM g_calls WHERE file_id=1 AND NOT is_null AND ac>0) AND var_id IN (SELECT var_id FROM g_calls WHERE file_id=2 AND NOT is_null AND ac>0)"),
    "any_filter_req": ({"any.filter.req": True}, "filter<>'PASS'"), "v_include": ({"v-include": "sqrt(size) > 5 and pow(size, 2) < 2000"}, "sqrt(size)>5 AND size*size<2000"), "id_req": ({"id.req": ["rs7", "rs12"]}, "name IN ('rs7','rs12')"), "locset_ex": ({"locset.ex": ["NATION_3"]}, "var_id NOT IN (SELECT var_id FROM vl JOIN g_sets USING (loc_id) WHERE set_name='NATION_3')"), "locset_req": ({"locset.req": ["NATION_3"]}, "var_id IN (SELECT var_id FROM vl JOIN g_sets USING (loc_id) WHERE set_name='NATION_3')"),
    "loc_skip": ({"loc": [0, 1, 2], "loc.skip": ["GENE3"]}, "var_id IN (SELECT var_id FROM vl WHERE altname<>'GENE3')"), "var_req": ({"var.req": ["S1"]}, "var_id%5=1"), "varset_req": ({"varset.req": ["Y"]}, "var_id%5>=2"),
    "both": ({"loc": [0], "reg": ["chr3"], "maf": ":0.01", "any.filter.ex": True}, "(var_id IN (SELECT var_id FROM vl WHERE group_id=0) OR chr=3) AND maf<=0.01 AND filter='PASS'"),
}
for _name, (_terms, _where) in MASKS.items():
    query(f"mask_{_name}", lambda s, terms=_terms: mask(s, terms).variants.select("var_id", "chr", "bp1"), f"SELECT var_id, chr, bp1 FROM vc v WHERE {_where}")

#: Masks that change people or genotypes, seen in what is left of the genotypes.
LEFT = {
    "indiv": ({"indiv": [1, 2, 4, 5]}, "indiv_id IN (1,2,4,5)"), "indiv_ex": ({"indiv.ex": [1, 2, 4, 5]}, "indiv_id NOT IN (1,2,4,5)"), "phe": ({"phe": ["strata:1:2"]}, "indiv_id IN (SELECT indiv_id FROM g_indiv WHERE strata IN (1,2))"),
    "phe_ex": ({"phe.ex": ["aff:2"]}, "indiv_id IN (SELECT indiv_id FROM g_indiv WHERE aff<>2)"), "phe_req": ({"phe.req": ["aff:2", "strata:0"]}, "indiv_id IN (SELECT indiv_id FROM g_indiv WHERE aff=2 AND strata=0)"), "phe_obs": ({"phe.obs": "qt"}, "true"),
    "assume_ref": ({"assume-ref": True}, "ac IS NOT NULL"), "no_geno": ({"no-geno": True}, "false"),
}
for _name, (_terms, _where) in LEFT.items():
    query(f"mask_{_name}", lambda s, terms=_terms: mask(s, terms).geno.select("var_id", "indiv_id", "ac"), f"SELECT var_id, indiv_id, ac FROM g_geno WHERE indiv_id IN (SELECT indiv_id FROM g_indiv) AND {_where}")
_REGENO = "SELECT var_id, indiv_id, CASE WHEN count(DISTINCT x)=1 THEN max(x) END AS ac FROM (SELECT var_id, indiv_id, {x} AS x FROM g_calls WHERE {w}) k GROUP BY 1,2"
for _name, _terms, _x, _w in (("file", {"file": [1]}, "CASE WHEN NOT is_null THEN ac END", "file_id=1"), ("file_ex", {"file.ex": [1]}, "CASE WHEN NOT is_null THEN ac END", "file_id<>1"),
    ("geno", {"geno": ["dp:ge:30", "gq:ge:90"]}, "CASE WHEN NOT is_null AND (dp>=30 OR gq>=90) THEN ac END", "true"), ("geno_req", {"geno.req": ["dp:ge:10", "gq:ge:30"]}, "CASE WHEN NOT is_null AND dp>=10 AND gq>=30 THEN ac END", "true")):
    query(f"mask_{_name}", lambda s, terms=_terms: mask(s, terms).geno.select("var_id", "indiv_id", "ac"), _REGENO.format(x=_x, w=_w))
#: Masks that name groups.
NAMED = {
    "loc_group": ({"loc.group": [1]}, "SELECT DISTINCT altname AS grp, var_id FROM vl WHERE group_id=1"), "locset_group": ({"locset.group": True}, "SELECT DISTINCT set_name AS grp, var_id FROM vl JOIN g_sets USING (loc_id)"),
    "varset_group": ({"varset.group": ["S1", "S3"]}, "SELECT set_name AS grp, var_id FROM g_varsets WHERE set_name IN ('S1','S3')"), "all_group": ({"all.group": True, "qual": "920:950"}, "SELECT 'all' AS grp, var_id FROM g_variants WHERE qual BETWEEN 920 AND 950"),
    "empty_group": ({"loc.group": [0], "empty.group": True, "reg": ["chr3"]}, "SELECT g.altname AS grp, var_id FROM (SELECT DISTINCT altname FROM g_loci WHERE group_id=0) g LEFT JOIN (SELECT DISTINCT altname, var_id FROM vl WHERE group_id=0 AND chr=3) v USING (altname)"),
}
for _name, (_terms, _body) in NAMED.items():
    query(f"mask_{_name}", lambda s, terms=_terms: mask(s, terms).groups.select(F.col("group").alias("grp"), "var_id"), _body)
for _name, _terms, _column, _of in (("loc_append", {"loc.append": [1]}, "loc_names", "SELECT var_id, list_sort(list(DISTINCT altname)) AS x FROM vl WHERE group_id=1 GROUP BY 1"),
    ("locset_append", {"locset.append": ["EUROPE", "ASIA"]}, "locset_names", "SELECT var_id, list_sort(list(DISTINCT set_name)) AS x FROM vl JOIN g_sets USING (loc_id) WHERE superset_name IN ('EUROPE','ASIA') GROUP BY 1"),
    ("var_append", {"var.append": ["S1", "S2"]}, "var_names", "SELECT var_id, list_sort(list(DISTINCT set_name)) AS x FROM g_varsets WHERE set_name IN ('S1','S2') GROUP BY 1"),
    ("varset_append", {"varset.append": ["X"]}, "varset_names", "SELECT var_id, list_sort(list(DISTINCT set_name)) AS x FROM g_varsets WHERE superset_name='X' GROUP BY 1"),
    ("ref_append", {"ref.append": ["A", "B"]}, "ref_names", "SELECT v.var_id, list_sort(list(DISTINCT r.name)) AS x FROM g_variants v JOIN g_ref r ON v.chr=r.chr AND v.bp1=r.bp1 GROUP BY 1")):
    query(f"mask_{_name}", lambda s, terms=_terms, c=_column: mask(s, terms).variants.select("var_id", F.array_join(c, "|").alias("names")), f"SELECT v.var_id, array_to_string(x, '|') AS names FROM g_variants v LEFT JOIN ({_of}) a USING (var_id)")

_FISHER = """(SELECT list_sum(list_filter(q, lambda x: x <= p0*(1+1e-7))) FROM (SELECT list_transform(range(greatest(0,({a}+{b})+({a}+{c})-({a}+{b}+{c}+{d})), least({a}+{b},{a}+{c})+1),
 lambda k: exp(lgamma({a}+{b}+1)+lgamma({c}+{d}+1)+lgamma({a}+{c}+1)+lgamma({b}+{d}+1)-lgamma({a}+{b}+{c}+{d}+1)-lgamma(k+1)-lgamma({a}+{b}-k+1)-lgamma({a}+{c}-k+1)-lgamma({d}-{a}+k+1))) AS q,
 exp(lgamma({a}+{b}+1)+lgamma({c}+{d}+1)+lgamma({a}+{c}+1)+lgamma({b}+{d}+1)-lgamma({a}+{b}+{c}+{d}+1)-lgamma({a}+1)-lgamma({b}+1)-lgamma({c}+1)-lgamma({d}+1)) AS p0) z)"""
_CHI2 = "CASE WHEN CAST({a}+{b} AS DOUBLE)*({c}+{d})*({a}+{c})*({b}+{d})<=1e-10 THEN 0 ELSE ({a}+{b}+{c}+{d})*pow(CAST({a} AS DOUBLE)*({d})-CAST({b} AS DOUBLE)*({c}),2)/(CAST({a}+{b} AS DOUBLE)*({c}+{d})*({a}+{c})*({b}+{d})) END"
_OR = "CASE WHEN {a}=0 OR {b}=0 OR {c}=0 OR {d}=0 THEN ({a}+0.5)*({d}+0.5)/(({b}+0.5)*({c}+0.5)) ELSE CAST({a} AS DOUBLE)*({d})/(CAST({b} AS DOUBLE)*({c})) END"
_CELLS = {"": ("a_ac", "(a_tot-a_ac)", "u_ac", "(u_tot-u_ac)"), "dom": ("(a_het+a_hom)", "a_rr", "(u_het+u_hom)", "u_rr"), "rec": ("a_hom", "(a_rr+a_het)", "u_hom", "(u_rr+u_het)")}
query("v_assoc", A.v_assoc, "SELECT var_id, round(maf,6) AS maf, a_rr AS refa, a_het AS heta, a_hom AS homa, u_rr AS refu, u_het AS hetu, u_hom AS homu, " + ", ".join(
    f"round({t.format(**dict(zip('abcd', cells)))},6) AS {n}{tag}" for tag, cells in _CELLS.items() for n, t in (("chi2", _CHI2), ("p", "least(1.0," + _FISHER + ")"), ("or", _OR))) + " FROM vc")
query("glm_linear", A.glm_linear, """SELECT var_id, CAST(n AS BIGINT) AS n, round(beta,6) AS beta, round(se,6) AS se, round(beta/se,6) AS stat FROM (
 SELECT *, sqrt((cyy-beta*cxy)/(n-2)/cxx) AS se FROM (SELECT *, cxy/cxx AS beta FROM (SELECT var_id, n, sxx-sx*sx/n AS cxx, sxy-sx*sy/n AS cxy, syy-sy*sy/n AS cyy FROM (
 SELECT var_id, tn-ln AS n, sx, sxx, sxy, ty-ly AS sy, tyy-lyy AS syy FROM (SELECT var_id, CAST(coalesce(sum(ac),0) AS DOUBLE) AS sx, CAST(coalesce(sum(ac*ac),0) AS DOUBLE) AS sxx, coalesce(sum(ac*qt),0) AS sxy,
 count(*) FILTER (ac IS NULL) AS ln, coalesce(sum(qt) FILTER (ac IS NULL),0) AS ly, coalesce(sum(qt*qt) FILTER (ac IS NULL),0) AS lyy FROM g_geno JOIN g_indiv USING (indiv_id) WHERE qt IS NOT NULL GROUP BY 1) a
 CROSS JOIN (SELECT CAST(count(qt) AS DOUBLE) AS tn, sum(qt) AS ty, sum(qt*qt) AS tyy FROM g_indiv) b) c) d WHERE cxx>1e-9 AND n>2) e) f""")
query("glm_logistic", lambda s: A.glm(s))
query("gene_tests", A.gene_tests, """, car AS (SELECT loc_id, g.var_id, indiv_id, ac, aff FROM vl JOIN g_geno g ON vl.var_id=g.var_id JOIN g_indiv USING (indiv_id) WHERE ac>0),
 ea AS (SELECT loc_id, var_id, CAST(sum(ac) AS DOUBLE) AS k, CAST(sum(CASE WHEN aff=2 THEN ac ELSE 0 END) AS DOUBLE) AS ka, count(*) FILTER (aff=2) AS ca, count(*) FILTER (aff<>2) AS cu, any_value(CAST(na AS DOUBLE)/n.n) AS sh, any_value(n.n) AS nn, any_value(na) AS na, any_value(nu) AS nu FROM car CROSS JOIN n GROUP BY 1,2),
 bv AS (SELECT loc_id, count(*) AS nvar, sum(CHI2) AS sumstat, count(*) FILTER (ca>0 AND cu=0) AS uniq_a, count(*) FILTER (cu>0 AND ca=0) AS uniq_u, sum((ka-sh*k)/sqrt((1+k)/(2+nn)*(1-(1+k)/(2+nn)))) AS frqwgt,
 sum(pow(ka-k*sh,2)-k*sh*(1-sh)) AS t, sum(k*sh*(1-sh)*(1+(2*k-6)*sh*(1-sh))-pow(k*sh*(1-sh),2)) AS v FROM ea GROUP BY 1),
 st AS (SELECT loc_id, k, sum(ka) AS ka, sum(k) AS s, sum(k*k) AS s2, any_value(sh) AS sh FROM ea GROUP BY 1,2),
 vt AS (SELECT loc_id, max(z) AS vt FROM (SELECT loc_id, (sum(ka) OVER w - sh*sum(s) OVER w)/sqrt(sum(s2) OVER w) AS z FROM st WINDOW w AS (PARTITION BY loc_id ORDER BY k)) q GROUP BY 1),
 pe AS (SELECT loc_id, indiv_id, aff, CAST(sum(ac) AS DOUBLE) AS b, count(*) AS hits FROM car GROUP BY 1,2,3),
 bu AS (SELECT loc_id, sum(CASE WHEN aff=2 THEN b ELSE 0 END)/na AS ma, sum(CASE WHEN aff<>2 THEN b ELSE 0 END)/nu AS mu, sum(CASE WHEN aff=2 THEN b*b ELSE 0 END)/na AS qa, sum(CASE WHEN aff<>2 THEN b*b ELSE 0 END)/nu AS qu, na, nu,
 count(*) FILTER (aff=2 AND hits>1)-count(*) FILTER (aff<>2 AND hits>1) AS mhit FROM pe CROSS JOIN n GROUP BY loc_id, na, nu)
 SELECT bv.loc_id, nvar, round(sumstat,6) AS sumstat, round(CASE WHEN ma>mu THEN (ma-mu)/sqrt((qa-ma*ma)/na+(qu-mu*mu)/nu) ELSE 0 END,6) AS burden, uniq_a, uniq_u, mhit, round(frqwgt,6) AS frqwgt, round(vt,6) AS vt,
 round(CASE WHEN v>0 THEN t/sqrt(v) END,6) AS calpha FROM bv JOIN bu USING (loc_id) JOIN vt USING (loc_id)""".replace(", car AS", "SELECT * FROM (WITH car AS", 1).replace("CHI2", _CHI2.format(a="ca", b="(na-ca)", c="cu", d="(nu-cu)")) + ")")
query("gene_permuted", A.permuted)
query("skat", A.skat)
query("cancor", E.cancor)
query("skat_o", A.skat_o)
query("stepup", E.stepup)
query("net_assoc", W.net_assoc)
query("net_partners", W.net_partners)
query("smp", W.smp)
query("v_assoc_permuted", W.v_assoc_permuted)
query("gene_assoc", lambda s: E.gene_assoc(s, (20, 40)))
query("two_hit", E.two_hit, """, car AS (SELECT loc_id, g.var_id, indiv_id, ac, aff FROM vl JOIN g_geno g ON vl.var_id=g.var_id JOIN g_indiv USING (indiv_id) WHERE ac>0),
 bo AS (SELECT a.loc_id, a.var_id AS v, b.var_id AS u, a.indiv_id, greatest(a.ac,b.ac) AS most FROM car a JOIN car b ON a.loc_id=b.loc_id AND a.indiv_id=b.indiv_id AND a.var_id<b.var_id),
 al AS (SELECT loc_id, var_id, count(*) AS k FROM car GROUP BY 1,2),
 ok AS (SELECT p.loc_id, v, u FROM (SELECT loc_id, v, u, count(*) AS k FROM bo GROUP BY 1,2,3 HAVING max(most)=1) p JOIN al a ON a.loc_id=p.loc_id AND a.var_id=v JOIN al b ON b.loc_id=p.loc_id AND b.var_id=u WHERE a.k>p.k AND b.k>p.k),
 tw AS (SELECT DISTINCT loc_id, indiv_id FROM bo JOIN ok USING (loc_id, v, u)),
 pe AS (SELECT c.loc_id, c.indiv_id, aff, max(ac)=2 OR max(tw.indiv_id) IS NOT NULL AS hit, min(ac)=1 AS het FROM car c LEFT JOIN tw ON tw.loc_id=c.loc_id AND tw.indiv_id=c.indiv_id GROUP BY 1,2,3),
 s AS (SELECT loc_id, count(*) FILTER (hit AND aff=2) AS cases, count(*) FILTER (hit AND aff=1) AS controls, count(*) FILTER (het AND aff=2) AS case_hets, count(*) FILTER (het AND aff=1) AS control_hets FROM pe GROUP BY 1),
 q AS (SELECT s.*, na, nu, (2*controls+control_hets)/(2.0::DOUBLE*nu) AS af FROM s CROSS JOIN n),
 r AS (SELECT *, CASE WHEN greatest(af*af, controls/CAST(nu AS DOUBLE))=0 THEN 1e-4 ELSE greatest(af*af, controls/CAST(nu AS DOUBLE)) END AS p FROM q),
 t AS (SELECT *, risk*p+1-p AS den FROM (SELECT *, 1.1::DOUBLE+0.1::DOUBLE*unnest(range(0,490)) AS risk FROM r WHERE p<1) x),
 l AS (SELECT *, risk*p/den AS sick, (1-risk*0.01::DOUBLE/den)*p/(1-0.01::DOUBLE) AS well FROM t),
 b AS (SELECT loc_id, max(cases*ln(sick)+(na-cases)*ln(1-sick)+controls*ln(well)+(nu-controls)*ln(1-well)) AS best FROM l WHERE sick<1 AND well>0 AND well<1 GROUP BY 1)
 SELECT loc_id, cases, controls, case_hets, control_hets, round(af,6) AS af, CASE WHEN p<1 THEN round(2*greatest(coalesce(best,-1e300)-((cases+controls)*ln(p)+(na-cases+nu-controls)*ln(1-p)),0),6) END AS chi2 FROM r LEFT JOIN b USING (loc_id)""".replace(", car AS", "SELECT * FROM (WITH car AS", 1) + ")")
query("concordance", Y.concordance, """SELECT indiv_id, count(*) AS n, count(*) FILTER (g1<>g2) AS disc, count(*) FILTER (g1=0 AND g2>0) AS ref_alt, count(*) FILTER (g1>0 AND g2>0 AND g1<>g2) AS alt_alt, round(1-count(*) FILTER (g1<>g2)/CAST(count(*) AS DOUBLE),6) AS rate
 FROM (SELECT a.indiv_id, a.ac AS g1, b.ac AS g2 FROM g_calls a JOIN g_calls b ON a.var_id=b.var_id AND a.indiv_id=b.indiv_id WHERE a.file_id=1 AND b.file_id=2 AND NOT a.is_null AND NOT b.is_null) x GROUP BY 1""")
query("denovo", Y.denovo, """SELECT child, count(*) FILTER (lost) AS missing, count(*) FILTER (NOT lost AND one AND c=0) AS trans_ref_from_het, count(*) FILTER (NOT lost AND one AND c=1) AS trans_alt_from_het,
 count(*) FILTER (NOT lost AND (c<lo OR c>hi)) AS non_mendelian, count(*) FILTER (NOT lost AND c=1) AS child_het, count(*) FILTER (NOT lost AND p=0 AND m=0 AND c=1) AS potential_denovo FROM (
 SELECT *, (c<0 OR p<0 OR m<0) AS lost, ((p=1 AND m=0) OR (m=1 AND p=0)) AS one, CAST(p=2 AS INT)+CAST(m=2 AS INT) AS lo, CAST(p>0 AS INT)+CAST(m>0 AS INT) AS hi FROM (
 SELECT child, var_id, coalesce(max(ac) FILTER (who='c'),0) AS c, coalesce(max(ac) FILTER (who='p'),0) AS p, coalesce(max(ac) FILTER (who='m'),0) AS m FROM (
 SELECT t.indiv_id AS child, g.var_id, w.who, coalesce(g.ac,-1) AS ac FROM g_indiv t CROSS JOIN (VALUES ('c'),('p'),('m')) w(who) JOIN g_geno g ON g.indiv_id=CASE w.who WHEN 'c' THEN t.indiv_id WHEN 'p' THEN t.pat ELSE t.mat END
 WHERE t.pat IN (SELECT indiv_id FROM g_indiv) AND t.mat IN (SELECT indiv_id FROM g_indiv)) a GROUP BY 1,2) b) d GROUP BY 1""")
query("ibs", Y.ibs, """, g AS (SELECT g.* FROM g_geno g JOIN vc USING (var_id) WHERE NOT flip), lo AS (SELECT indiv_id, count(*) AS k FROM g WHERE ac IS NULL GROUP BY 1),
 bo AS (SELECT x.indiv_id AS i, y.indiv_id AS j, count(*) AS kk FROM g x JOIN g y ON x.var_id=y.var_id AND x.indiv_id<y.indiv_id WHERE x.ac IS NULL AND y.ac IS NULL GROUP BY 1,2)
 SELECT id1, id2, ibs, (SELECT count(*) FROM vc WHERE NOT flip)-coalesce(a.k,0)-coalesce(b.k,0)+coalesce(kk,0) AS obs FROM (SELECT x.indiv_id AS id1, y.indiv_id AS id2, count(*) AS ibs FROM g x JOIN g y ON x.var_id=y.var_id AND x.indiv_id<y.indiv_id
 WHERE x.ac>0 AND y.ac>0 GROUP BY 1,2) s LEFT JOIN lo a ON a.indiv_id=id1 LEFT JOIN lo b ON b.indiv_id=id2 LEFT JOIN bo ON i=id1 AND j=id2""".replace(", g AS", "SELECT * FROM (WITH g AS", 1) + ")")
query("proximity", Y.proximity, """, p AS (SELECT lag(var_id) OVER w AS before, var_id, bp1-lag(bp1) OVER w AS dist FROM g_variants WINDOW w AS (PARTITION BY chr ORDER BY bp1, var_id)), q AS (SELECT * FROM p WHERE dist<=40),
 k AS (SELECT q.before, q.var_id, q.dist, i.indiv_id, CASE WHEN a.var_id IS NULL THEN 0.0 ELSE CAST(a.ac AS DOUBLE) END AS x, CASE WHEN b.var_id IS NULL THEN 0.0 ELSE CAST(b.ac AS DOUBLE) END AS y FROM q CROSS JOIN g_indiv i
 LEFT JOIN g_geno a ON a.var_id=q.before AND a.indiv_id=i.indiv_id LEFT JOIN g_geno b ON b.var_id=q.var_id AND b.indiv_id=i.indiv_id),
 z AS (SELECT before, var_id, dist, count(*) FILTER (x>0 AND y>0) AS both, count(*) FILTER (x>0 OR y>0) AS either, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, sum(x) FILTER (y IS NOT NULL) AS sx, sum(y) FILTER (x IS NOT NULL) AS sy,
 sum(x*x) FILTER (y IS NOT NULL) AS sxx, sum(y*y) FILTER (x IS NOT NULL) AS syy, sum(x*y) AS sxy FROM k GROUP BY 1,2,3)
 SELECT before, var_id, dist, "both", either, CASE WHEN (n*sxx-sx*sx)*(n*syy-sy*sy)>0 THEN round((n*sxy-sx*sy)/sqrt((n*sxx-sx*sx)*(n*syy-sy*sy)),6) END AS r FROM z""".replace(", p AS", "SELECT * FROM (WITH p AS", 1) + ")")
query("loc_intersect", L.loc_intersect, "SELECT a.loc_id, count(DISTINCT b.altname) AS n, array_to_string(list_sort(list(DISTINCT b.altname)),'|') AS genes FROM g_loci a JOIN g_loci b ON a.chr=b.chr AND a.bp1<=b.bp2 AND a.bp2>=b.bp1 WHERE a.group_id=0 AND b.group_id<>0 GROUP BY 1")
query("loc_overlap", L.loc_overlap, "SELECT a.loc_id AS loc_a, b.loc_id AS loc_b, least(a.bp2,b.bp2)-greatest(a.bp1,b.bp1)+1 AS intersection, greatest(a.bp2,b.bp2)-least(a.bp1,b.bp1)+1 AS joint FROM g_loci a JOIN g_loci b ON a.chr=b.chr AND a.bp1<=b.bp2 AND a.bp2>=b.bp1 WHERE a.group_id=0 AND b.group_id=1")
query("loc_merge", L.loc_merge, "SELECT group_id, altname, chr, min(bp1) AS bp1, max(bp2) AS bp2, count(*) AS parts FROM g_loci GROUP BY 1,2,3")
query("loc_flatten", L.loc_flatten, """SELECT chr, min(bp1) AS bp1, max(bp2) AS bp2, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY chr ORDER BY bp1, bp2, loc_id ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN max(bp2) OVER (PARTITION BY chr ORDER BY bp1, bp2, loc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= bp1-1 THEN 0 ELSE 1 END AS fresh FROM g_loci) a) b GROUP BY chr, island""")
query("loc_subtract", L.loc_subtract, """SELECT chr, min(p) AS bp1, max(p) AS bp2 FROM (SELECT chr, p, p-row_number() OVER (PARTITION BY chr ORDER BY p) AS run FROM (
 SELECT DISTINCT chr, unnest(range(bp1,bp2+1)) AS p FROM g_loci WHERE group_id=0 EXCEPT SELECT DISTINCT chr, unnest(range(bp1,bp2+1)) AS p FROM g_loci WHERE group_id=1) a) b GROUP BY chr, run""")
query("intersect", L.intersect, "SELECT loc_id, altname FROM g_loci l WHERE EXISTS (SELECT 1 FROM g_variants v WHERE v.chr=l.chr AND v.bp1 BETWEEN l.bp1 AND l.bp2)")
query("loc_summary", L.loc_summary, "SELECT group_id, count(*) AS n, CAST(sum(bp2-bp1+1) AS BIGINT) AS bases FROM g_loci GROUP BY 1")
query("ref_summary", L.ref_summary, "SELECT grp, count(*) AS n FROM g_ref GROUP BY 1")
query("var_summary", L.var_summary, "SELECT file_id, count(DISTINCT var_id) AS variants, count(DISTINCT indiv_id) AS people, count(*) AS calls FROM g_calls GROUP BY 1")
query("ind_summary", L.ind_summary, "SELECT pheno, count(value) AS observed, count(DISTINCT value) AS values FROM g_pheno GROUP BY 1")
query("i_view", L.i_view, "SELECT indiv_id, sex, pat, mat, CAST(aff AS DOUBLE) AS aff, round(qt,6) AS qt, CAST(strata AS DOUBLE) AS strata FROM g_indiv")
query("g_matrix", L.g_matrix, "SELECT gene, indiv_id, CAST(sum(ac) AS BIGINT) AS ac FROM (SELECT DISTINCT altname AS gene, var_id FROM vl) v JOIN g_geno g USING (var_id) WHERE ac>0 GROUP BY 1,2")
query("net_view", L.net_view, "SELECT DISTINCT a, b, 1 AS hops FROM g_edges WHERE score>=0")
query("net_view_2", lambda s: L.net_view(s, 2), "SELECT a, b, min(hops) AS hops FROM (SELECT a, b, 1 AS hops FROM g_edges WHERE score>=0 UNION ALL SELECT x.a, y.b, 2 FROM g_edges x JOIN g_edges y ON x.b=y.a WHERE x.score>=0 AND y.score>=0 AND x.a<>y.b) q GROUP BY 1,2")
query("net_carriers", L.net_carriers, """SELECT seed, count(*) FILTER (aff=2) AS cases, count(*) FILTER (aff=1) AS controls FROM (SELECT DISTINCT seed, indiv_id FROM (SELECT a AS seed, b AS loc_id FROM g_edges UNION SELECT a, a FROM g_edges) e
 JOIN vl USING (loc_id) JOIN g_geno g ON vl.var_id=g.var_id WHERE ac>0) x JOIN g_indiv USING (indiv_id) GROUP BY 1""")
query("seq_stats", L.seq_stats, "SELECT doc_id, length(seq) AS length, length(seq)-length(translate(seq,'GC','')) AS gc, length(seq)-length(translate(seq,'N','')) AS n, length(seq)-length(translate(seq,'ACGT','')) AS acgt, CAST((length(seq)-length(replace(seq,'CG','')))/2 AS BIGINT) AS cg FROM g_seq")
query("kmers", L.kmers, "SELECT kmer, count(*) AS n FROM (SELECT substr(seq, CAST(i AS INT), 2) AS kmer FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM g_seq WHERE length(seq)>=2) a) b WHERE NOT regexp_matches(kmer,'[^ACGT]') GROUP BY 1")
query("lookup", L.lookup, f"""SELECT var_id, 'alleles' AS key, concat(ref,'/',alt) AS value FROM g_variants UNION ALL SELECT var_id, 'titv', CASE WHEN {TI} THEN 'ti' ELSE 'tv' END FROM g_variants UNION ALL SELECT var_id, 'case_alt', CAST(a_ac AS VARCHAR) FROM vc
 UNION ALL SELECT var_id, 'control_alt', CAST(u_ac AS VARCHAR) FROM vc UNION ALL (SELECT DISTINCT var_id, 'locus', altname FROM vl) UNION ALL (SELECT DISTINCT v.var_id, concat('ref_',grp), '1' FROM g_variants v JOIN g_ref r ON v.chr=r.chr AND v.bp1=r.bp1)""")
query("indiv_enrich", L.indiv_enrich, """SELECT indiv_id, st AS set, obs, total, round(f,6) AS f, round((obs-f/(1-f)*(total-obs))/sqrt(f/(1-f)*total),6) AS z FROM (
 SELECT h.indiv_id, s.superset_name AS st, count(*) AS obs FROM (SELECT DISTINCT indiv_id, loc_id FROM vl JOIN g_geno USING (var_id) WHERE ac>0) h JOIN g_sets s USING (loc_id) GROUP BY 1,2) a
 JOIN (SELECT indiv_id, count(DISTINCT loc_id) AS total FROM vl JOIN g_geno USING (var_id) WHERE ac>0 GROUP BY 1) b USING (indiv_id)
 JOIN (SELECT superset_name AS st, sum(bp2-bp1+1)/CAST((SELECT sum(bp2-bp1+1) FROM g_loci) AS DOUBLE) AS f FROM g_loci JOIN g_sets USING (loc_id) GROUP BY 1) c USING (st)""")

_LABEL = "concat(CASE WHEN ac IS NULL THEN '.' WHEN ac>=2 THEN alt ELSE ref END, '/', CASE WHEN ac IS NULL THEN '.' WHEN ac>=1 THEN alt ELSE ref END)"
#: Carriers of the minor allele; who has no row has two reference alleles.
_MINOR = """(SELECT v.var_id, v.chr, v.bp1, v.ref, v.alt, i.indiv_id, coalesce(g.ac,0) AS ac FROM vc v CROSS JOIN g_indiv i LEFT JOIN g_geno g ON g.var_id=v.var_id AND g.indiv_id=i.indiv_id
 WHERE (g.var_id IS NULL OR g.ac IS NOT NULL) AND CASE WHEN v.flip THEN coalesce(g.ac,0)<2 ELSE coalesce(g.ac,0)>0 END)"""
_GENES = "(SELECT DISTINCT altname AS gene, var_id FROM vl)"
query("v_view", V.v_view, """SELECT var_id, chr, bp1, name, ref, alt, filter, round(qual,6) AS qual, coalesce(files,'') AS files, coalesce(calls,0) AS calls FROM g_variants v LEFT JOIN (
 SELECT var_id, string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY file_id) AS files, CAST(sum(k) AS BIGINT) AS calls FROM (SELECT var_id, file_id, count(*) AS k FROM g_calls GROUP BY 1,2) a GROUP BY 1) b USING (var_id)""")
for _name, _kw, _where in (("v_view_genotypes", {}, "true"), ("v_view_hide_null", {"hide_null": True}, "ac IS NOT NULL"), ("v_view_only_alt", {"only_alt": True}, "ac>0")):
    query(_name, lambda s, kw=_kw: V.v_view_genotypes(s, **kw), f"SELECT var_id, indiv_id, {_LABEL} AS genotype FROM g_geno JOIN g_variants USING (var_id) WHERE {_where}")
query("rv_view", V.rv_view, f"SELECT var_id, chr, bp1, indiv_id, {_LABEL} AS genotype FROM {_MINOR} m")
query("mv_view", V.mv_view, "SELECT 'all' AS grp, var_id, chr, bp1, ref, alt, a_ac AS case_alt, u_ac AS control_alt FROM vc")
query("mrv_view", V.mrv_view, f"SELECT indiv_id, count(*) AS variants, CAST(sum(ac) AS BIGINT) AS alt, 'all' AS grp FROM {_MINOR} m GROUP BY 1")
query("g_view", V.g_view, f"SELECT gene, var_id, chr, bp1, ref, alt, a_ac AS case_alt, u_ac AS control_alt FROM {_GENES} g JOIN vc USING (var_id)")
query("g_view_rarelist", V.g_view_rarelist, f"SELECT gene, indiv_id, count(*) AS n, string_agg(CAST(var_id AS VARCHAR), ',' ORDER BY bp1, var_id) AS var_ids FROM {_GENES} g JOIN {_MINOR} m USING (var_id) GROUP BY 1,2")
query("loc_view", V.loc_view, "SELECT loc_id, group_id, altname, chr, bp1, bp2, bp2-bp1+1 AS bases, coalesce(sets,'') AS sets FROM g_loci LEFT JOIN (SELECT loc_id, string_agg(DISTINCT set_name, '|' ORDER BY set_name) AS sets FROM g_sets GROUP BY 1) s USING (loc_id)")
query("ref_view", lambda s: V.ref_view(s, "B"), "SELECT grp, name, chr, bp1, alt FROM g_ref WHERE grp='B'")
query("seg_view", V.seg_view, "SELECT indiv_id, aff, CAST(seg AS BIGINT) AS seg, n FROM g_segments JOIN g_indiv USING (indiv_id)")
query("prot_view", V.prot_view, "SELECT transcript, source, feature, var_id FROM g_prot p JOIN g_variants v ON v.chr=p.chr AND v.bp1 BETWEEN p.bp1 AND p.bp2")
query("prot_summary", V.prot_summary, "SELECT source, count(*) AS n, count(DISTINCT feature) AS features, count(DISTINCT transcript) AS transcripts FROM g_prot GROUP BY 1")
_FIVE = [1, 2, 4, 5, 7]
query("v_matrix", lambda s: V.v_matrix(s, _FIVE), "SELECT v.var_id, " + ", ".join(f"coalesce(max(CASE WHEN indiv_id={i} THEN coalesce(ac,-1) END),0) AS i{i}" for i in _FIVE) + " FROM g_variants v LEFT JOIN g_geno g USING (var_id) GROUP BY 1")
query("meta_matrix", lambda s: V.meta_matrix(s, ["qual", "size"]), "SELECT var_id, chr, bp1, round(qual,6) AS qual, size FROM g_variants")
query("v_meta_matrix", lambda s: V.v_meta_matrix(s, _FIVE), "SELECT var_id, " + ", ".join(f"round(max(CASE WHEN indiv_id={i} THEN dp END),6) AS i{i}" for i in _FIVE) + f" FROM g_calls WHERE indiv_id IN ({','.join(map(str, _FIVE))}) GROUP BY 1")
query("g_meta_matrix", V.g_meta_matrix, f"SELECT gene, indiv_id, round(avg(x),6) AS mean, count(x) AS n FROM (SELECT var_id, indiv_id, max(dp) AS x FROM g_calls GROUP BY 1,2) c JOIN {_GENES} g USING (var_id) GROUP BY 1,2")
query("seg_summary", V.seg_summary, "SELECT segments, count(*) AS people, CAST(sum(events) AS BIGINT) AS events FROM (SELECT indiv_id, count(*) AS segments, sum(n) AS events FROM g_segments GROUP BY 1) a GROUP BY 1")
query("seq_summary", V.seq_summary, "SELECT count(seq) AS sequences, min(length(seq)) AS shortest, max(length(seq)) AS longest, CAST(sum(length(seq)) AS BIGINT) AS bases FROM g_seq")
query("meta_summary", V.meta_summary)
query("score_weights", lambda s: V.score_weights(s, s.metas.select("var_id", F.col("value").cast("double").alias("weight"))), "SELECT indiv_id, round(sum(ac*(size/10.0)),6) AS score, count(*) AS n FROM g_geno JOIN g_variants USING (var_id) WHERE ac>0 AND var_id%3=0 GROUP BY 1")


def record_query(name: str, make: Callable[[R.Records], DataFrame], body: str | None = None) -> None:
    """A query over records of several files."""
    QUERIES[name] = lambda spark, sf_dir: S.rounded(make(R.records(spark, sf_dir)))
    if body:
        SQL[name] = R.sql(body)


for _name, _mode, _view in (("merge_none", "no-merge", "r_none"), ("merge_exact", "exact-merge", "r_exact"), ("merge_any", "any-merge", "r_any")):
    record_query(_name, lambda r, mode=_mode: M.variants(M.merged(r.sites, mode)), f"""SELECT var_id, chr, start AS bp1, stop AS bp2, records, files, alleles FROM (SELECT var_id, min(chr) AS chr, min(bp1) AS start, max(bp2) AS stop,
     count(DISTINCT site_id) AS records, count(DISTINCT file_id) AS files FROM {_view} GROUP BY 1) v JOIN (SELECT var_id, string_agg(DISTINCT al, ' ' ORDER BY al) AS alleles FROM (
     SELECT var_id, concat(CAST(bp1-min(bp1) OVER (PARTITION BY var_id) AS VARCHAR), ':', ref, '>', a) AS al FROM (SELECT var_id, bp1, ref, unnest(alts) AS a FROM {_view}) x) y GROUP BY 1) z USING (var_id)""")
record_query("consensus_genotypes", lambda r: M.consensus(M.merged(r.sites), r.genotypes), """SELECT var_id, indiv_id, CASE WHEN count(DISTINCT t)=1 THEN max(t) END AS genotype FROM (
 SELECT var_id, indiv_id, array_to_string(list_sort([CASE WHEN a1=0 THEN ref ELSE alts[a1] END, CASE WHEN a2=0 THEN ref ELSE alts[a2] END]), '/') AS t FROM r_geno JOIN r_exact USING (site_id) WHERE a1 IS NOT NULL) x GROUP BY 1,2""")
_SEEN = """SELECT var_id, indiv_id, min(ac) AS low, max(ac) AS high, min(ac) FILTER (ac>0) AS alt_low, list(DISTINCT file_id) AS seen FROM (
 SELECT var_id, indiv_id, file_id, CAST(a1>0 AS INT)+CAST(a2>0 AS INT) AS ac FROM r_geno JOIN r_exact USING (site_id) WHERE a1 IS NOT NULL) x GROUP BY 1,2"""
record_query("mask_soft_ref", lambda r: M.soft_or_hard(M.merged(r.sites), r.genotypes, r.members, False), f"SELECT var_id, indiv_id, CASE WHEN high=0 THEN 0 WHEN alt_low=high THEN high END AS ac FROM ({_SEEN}) s")
record_query("mask_hard_ref", lambda r: M.soft_or_hard(M.merged(r.sites), r.genotypes, r.members, True), f"""SELECT var_id, indiv_id, CASE WHEN low=high AND (high=0 OR len(list_filter(list_intersect(covers, files), lambda f: NOT list_contains(seen, f)))=0) THEN high END AS ac
 FROM ({_SEEN}) s JOIN (SELECT var_id, list(DISTINCT file_id) AS covers FROM r_exact GROUP BY 1) c USING (var_id) JOIN (SELECT indiv_id, list(DISTINCT file_id) AS files FROM r_members GROUP BY 1) m USING (indiv_id)""")
record_query("mask_downcode", lambda r: M.downcoded(M.merged(r.sites), r.genotypes), """SELECT site_id, var_id, alts[k] AS alt, indiv_id, CAST(a1=k AS INT)+CAST(a2=k AS INT) AS ac FROM (SELECT *, unnest(range(1, len(alts)+1)) AS k FROM r_exact) e JOIN r_geno USING (site_id)
 WHERE a1 IS NOT NULL AND (a1=k OR a2=k)""")
record_query("allele_counts", lambda r: M.allele_counts(M.merged(r.sites), r.genotypes), """SELECT site_id, alts[k] AS alt, CAST(coalesce(sum(CAST(a1=k AS INT)+CAST(a2=k AS INT)),0) AS BIGINT) AS n FROM (SELECT *, unnest(range(1, len(alts)+1)) AS k FROM r_exact) e
 LEFT JOIN r_geno USING (site_id) GROUP BY 1,2""")
_PLACED = "(SELECT g.*, s.chr, s.bp1, i.sex FROM r_geno g JOIN r_sites s USING (site_id) JOIN r_indiv i USING (indiv_id))"


def placed_genotypes(r: R.Records) -> DataFrame:
    return r.genotypes.join(r.sites.select("site_id", "chr", "bp1"), "site_id").join(r.indiv, "indiv_id")


record_query("mask_fix_xy", lambda r: G.fixed_xy(placed_genotypes(r), {23: "X", 24: "Y"}, [(23, 1000, 1030), (24, 1000, 1030)]).select("site_id", "indiv_id", "a1", "a2").where("a1 is not null"), f"""SELECT site_id, indiv_id,
 a1, CASE WHEN NOT single THEN a2 END AS a2 FROM (SELECT *, (chr=23 AND sex<>0 OR chr=24 AND sex=1) AND NOT bp1 BETWEEN 1000 AND 1030 AS single FROM {_PLACED} p) q
 WHERE a1 IS NOT NULL AND NOT (chr=24 AND sex<>1) AND (NOT single OR a1=a2)""")
for _model, _score in (("ALLELIC", "x+y"), ("DOM", "greatest(x,y)"), ("REC", "x*y"), ("REC2", "x*y"), ("ALLELIC2", "x+y"), ("ALLELIC3", "x+y"), ("NULL", "0")):
    record_query(f"genotype_model_{_model.lower()}", lambda r, m=_model: G.scored(r.genotypes, m).groupBy("site_id").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n")),
        f"SELECT site_id, CAST(sum(CASE WHEN a1 IS NULL THEN 0 ELSE {_score} END) AS BIGINT) AS score, count(*) AS n FROM (SELECT *, CAST(a1>0 AS INT) AS x, CAST(a2>0 AS INT) AS y FROM r_geno) g GROUP BY 1")
_HAPLOID = f"(SELECT site_id, a1, CASE WHEN NOT single THEN a2 END AS a2 FROM (SELECT *, chr=23 AND sex<>0 AS single FROM {_PLACED} p) q WHERE NOT single OR a1=a2)"
for _model, _one, _two in (("ALLELIC2", "2*x", "x+y"), ("ALLELIC3", "1+x", "x+y"), ("DOM", "x", "greatest(x,y)"), ("REC", "0", "x*y"), ("REC2", "x", "x*y")):
    record_query(f"genotype_model_x_{_model.lower()}", lambda r, m=_model: G.scored(G.fixed_xy(placed_genotypes(r), {23: "X"}, []).where("chr = 23"), m).groupBy("site_id").agg(F.sum("score").alias("score")),
        f"SELECT site_id, CAST(sum(CASE WHEN a1 IS NULL THEN 0 WHEN a2 IS NULL THEN {_one} ELSE {_two} END) AS BIGINT) AS score FROM (SELECT site_id, CASE WHEN NOT single OR a1=a2 THEN a1 END AS a1, CASE WHEN NOT single THEN a2 END AS a2,"
        f" CAST(a1>0 AS INT) AS x, CAST(a2>0 AS INT) AS y FROM (SELECT *, sex<>0 AS single FROM {_PLACED} p WHERE chr=23) q) z GROUP BY 1")  # fmt: skip
record_query("mask_hard_call", lambda r: G.hard_called(r.genotypes, "dosage", 0.2).select("site_id", "indiv_id", "ac"), "SELECT site_id, indiv_id, CASE WHEN dosage<=0.2 THEN 0 WHEN abs(dosage-1)<=0.2 THEN 1 WHEN dosage>=2-0.2 THEN 2 END AS ac FROM r_geno")
_EM = """, obs AS (SELECT site_id AS var_id, l0, l1, l2, count(*) AS w FROM r_geno GROUP BY 1,2,3,4), tot AS (SELECT var_id, CAST(sum(w) AS DOUBLE) AS n FROM obs GROUP BY 1),
 em AS (SELECT var_id, n, 1/(2*n) AS f, 0 AS i, false AS done FROM tot UNION ALL
 SELECT var_id, n, g AS f, i+1 AS i, abs(g-f)<1e-4 OR g<=0 OR g>=1 AS done FROM (SELECT e.var_id, e.n, e.f, e.i, sum(w*(l1*2*f*(1-f)+2*l2*f*f)/(l0*(1-f)*(1-f)+l1*2*f*(1-f)+l2*f*f))/(2*e.n) AS g
 FROM em e JOIN obs o ON e.var_id=o.var_id WHERE NOT e.done AND e.i<10 GROUP BY e.var_id, e.n, e.f, e.i) x)"""
QUERIES["em"] = lambda spark, sf_dir: S.rounded(G.em_frequencies(R.records(spark, sf_dir).genotypes.withColumnRenamed("site_id", "var_id")))
SQL["em"] = R.sql("SELECT var_id, CAST(n AS BIGINT) AS n, round(f,6) AS f FROM (SELECT *, max(i) OVER (PARTITION BY var_id) AS last FROM em) z WHERE i=last").replace("\nSELECT var_id, CAST(n", _EM + "\nSELECT var_id, CAST(n")
record_query("mask_em", lambda r: G.em_called(r.genotypes.withColumnRenamed("site_id", "var_id"), 0.6).select("var_id", "indiv_id", "dosage", "ac"))
SQL["mask_em"] = R.sql("""SELECT var_id, indiv_id, round(p1+2*p2,6) AS dosage, CASE WHEN greatest(p0,p1,p2)>=0.6 THEN CASE WHEN p0>=p1 AND p0>=p2 THEN 0 WHEN p1>=p2 THEN 1 ELSE 2 END END AS ac FROM (
 SELECT var_id, indiv_id, q0/(q0+q1+q2) AS p0, q1/(q0+q1+q2) AS p1, q2/(q0+q1+q2) AS p2 FROM (SELECT g.site_id AS var_id, indiv_id, l0*(1-f)*(1-f) AS q0, l1*2*f*(1-f) AS q1, l2*f*f AS q2 FROM r_geno g
 JOIN (SELECT * FROM (SELECT *, max(i) OVER (PARTITION BY var_id) AS last FROM em) z WHERE i=last) e ON e.var_id=g.site_id) x) y""").replace("\nSELECT var_id, indiv_id, round(", _EM + "\nSELECT var_id, indiv_id, round(")


def annotation_query(name: str, make: Callable[[Study], DataFrame], body: str) -> None:
    query(name, make)
    SQL[name] = sql("").rstrip() + ",\n" + annotation(body)


annotation_query("loc_annotate", N.loc_annotate, "SELECT * FROM an")
annotation_query("annot_summary", N.annotated_variants, "SELECT var_id, func, gene, CASE WHEN kinds>1 THEN 'mixed' ELSE func END AS annot_full, n FROM an_worst")
annotation_query("counts_func", N.counts_annotated, """SELECT v.var_id, ref, alt, CASE WHEN flip THEN ref ELSE alt END AS minor, CASE WHEN flip THEN a_tot-a_ac ELSE a_ac END AS cnta,
 CASE WHEN flip THEN u_tot-u_ac ELSE u_ac END AS cntu, a_tot AS tota, u_tot AS totu, func, gene FROM vc v LEFT JOIN an_worst w ON v.var_id=w.var_id""")
annotation_query("mask_annot_append", lambda s: mask(s, {"annot.append": True, "include": "func in ('nonsense', 'frameshift', 'missense')"}).variants.select("var_id", "func", "gene", "annot_full"),
    "SELECT var_id, func, gene, CASE WHEN kinds>1 THEN 'mixed' ELSE func END AS annot_full FROM an_worst WHERE func IN ('nonsense','frameshift','missense')")


def probands(s: Study) -> DataFrame:
    return s.indiv.where("indiv_id % 2 = 0").select(F.col("indiv_id").alias("proband"), (F.col("indiv_id") % 22 + 1).cast("int").alias("chr"), F.lit(1200).cast("long").alias("bp1"), F.lit(1500).cast("long").alias("bp2"))


query("mutation_screen", lambda s: H.mutation_screen(s, probands(s)), """SELECT proband, var_id, chr, bp1, CAST(CASE WHEN gp.v IS NULL THEN 0 ELSE gp.ac END AS INT) AS ac, count(partner) AS n_ibd,
 count(*) FILTER (partner IS NOT NULL AND (gp.v IS NULL OR gp.ac IS NOT NULL) AND (gq.v IS NULL OR gq.ac IS NOT NULL)) AS n_inform,
 count(*) FILTER (partner IS NOT NULL AND (gp.ac=2 AND gq.v IS NULL OR gp.v IS NULL AND gq.ac=2)) AS n_invalid, count(*) FILTER (partner IS NOT NULL AND gp.ac=1 AND gq.v IS NULL) AS n_a1,
 count(*) FILTER (partner IS NOT NULL AND gp.ac=1 AND gq.ac=2) AS n_a2, count(*) FILTER (partner IS NOT NULL AND gp.ac=1 AND gq.ac=1) AS n_hethet FROM (
 SELECT DISTINCT w.proband, v.var_id, w.chr, v.bp1, p.partner FROM (SELECT proband, chr, least(1200, min(bp1)) AS w1, greatest(1500, max(bp2)) AS w2 FROM met GROUP BY 1, 2) w JOIN g_variants v ON v.chr=w.chr AND v.bp1 BETWEEN w1 AND w2
 LEFT JOIN (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY proband, partner ORDER BY bp1 DESC, bp2 DESC)=1) p ON p.proband=w.proband AND v.bp1 BETWEEN p.bp1 AND p.bp2) x
 LEFT JOIN (SELECT var_id AS v, indiv_id AS i, ac FROM g_geno) gp ON gp.v=x.var_id AND gp.i=x.proband LEFT JOIN (SELECT var_id AS v, indiv_id AS i, ac FROM g_geno) gq ON gq.v=x.var_id AND gq.i=x.partner GROUP BY 1, 2, 3, 4, 5""")
SQL["mutation_screen"] = SQL["mutation_screen"].replace("\nSELECT proband,", """, met AS (SELECT i.indiv_id AS proband, s.partner, s.chr, s.bp1, s.bp2 FROM g_indiv i JOIN g_ibd2 s ON s.indiv_id=i.indiv_id AND s.chr=i.indiv_id%22+1
 AND s.bp1<=1500 AND s.bp2>=1200 WHERE i.indiv_id%2=0 AND s.partner IN (SELECT indiv_id FROM g_indiv))\nSELECT proband,""")
query("s_assoc", H.s_assoc)
query("s_assoc_counts", lambda s: H.s_assoc(s, 1).select("loc_id", "nvar", "burden", "aa", "au"), """SELECT loc_id, nvar, CAST(coalesce(sum(CASE WHEN cu=0 THEN ca END),0) AS BIGINT) AS burden, CAST(coalesce(sum(pa),0) AS BIGINT) AS aa, CAST(coalesce(sum(pu),0) AS BIGINT) AS au
 FROM (SELECT loc_id, var_id, count(*) OVER (PARTITION BY loc_id) AS nvar FROM vl) m LEFT JOIN (SELECT var_id, count(*) FILTER (aff=2) AS ca, count(*) FILTER (aff=1) AS cu FROM g_geno JOIN g_indiv USING (indiv_id) WHERE ac>0 GROUP BY 1 HAVING count(*) FILTER (aff=2)>0) c USING (var_id)
 LEFT JOIN (SELECT g.var_id, count(*) FILTER (q.aff=2) AS pa, count(*) FILTER (q.aff=1) AS pu FROM g_geno g JOIN g_variants v ON v.var_id=g.var_id JOIN g_indiv i ON i.indiv_id=g.indiv_id AND i.aff=2 JOIN g_ibd2 s ON s.indiv_id=g.indiv_id AND s.chr=v.chr AND v.bp1 BETWEEN s.bp1 AND s.bp2
 JOIN g_indiv q ON q.indiv_id=s.partner WHERE g.ac>0 GROUP BY 1) p ON p.var_id=m.var_id WHERE nvar>=2 GROUP BY 1, 2""")
query("ibd_sharing", lambda s: Y.ibd_sharing(s, s.ibd), """SELECT p.var_id, x, y, count(s.bp1) AS nseg, count(*) FILTER (s.chr=v.chr AND v.bp1 BETWEEN s.bp1 AND s.bp2) AS overlap, max(s.bp2-s.bp1+1) FILTER (s.chr=v.chr AND v.bp1 BETWEEN s.bp1 AND s.bp2) AS len
 FROM (SELECT a.var_id, a.indiv_id AS x, b.indiv_id AS y FROM g_geno a JOIN g_geno b ON a.var_id=b.var_id AND a.indiv_id<b.indiv_id WHERE a.ac>0 AND b.ac>0 AND a.var_id IN (SELECT var_id FROM g_geno WHERE ac>0 GROUP BY 1 HAVING count(*)<=10)) p
 JOIN g_variants v ON v.var_id=p.var_id LEFT JOIN (SELECT least(id1,id2) AS i, greatest(id1,id2) AS j, chr, bp1, bp2 FROM g_ibd) s ON s.i=x AND s.j=y GROUP BY 1, 2, 3""")

annotation_query("gs_view", N.gs_view, """SELECT transcript, gene, codon_no, chr, min(bp) FILTER (true) AS low, max(bp) AS high, min(exon) AS exon, max(exon)>min(exon) AS split, string_agg(base, '' ORDER BY i) AS codon,
 CASE WHEN count(*)<3 THEN 'x' ELSE substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', CAST(sum((strpos('TCAG',base)-1)*CASE i%3 WHEN 0 THEN 16 WHEN 1 THEN 4 ELSE 1 END)+1 AS INT), 1) END AS aa,
 string_agg(seen, ' ' ORDER BY i) AS variants, string_agg(refs, ' ' ORDER BY i) AS refs, max(features) AS features FROM gs_base b
 LEFT JOIN gs_seen s USING (transcript, chr, bp) LEFT JOIN (SELECT chr, bp1 AS bp, string_agg(concat(grp,':',name), ',' ORDER BY grp, name) AS refs FROM g_ref GROUP BY 1, 2) r USING (chr, bp)
 LEFT JOIN gs_feat f USING (transcript, codon_no) GROUP BY transcript, gene, codon_no, chr""")
SQL["gs_view"] = SQL["gs_view"].replace("\nSELECT transcript, gene, codon_no,", """, gs_part AS (SELECT *, unnest([{'f':50,'t':249,'k':0},{'f':350,'t':600,'k':1},{'f':700,'t':800,'k':2}]) AS u FROM g_genome),
 gs_each AS (SELECT concat('T', CAST(loc_id AS VARCHAR)) AS transcript, altname AS gene, chr, minus, b, s0, g, u.k AS k, u.f AS f, u.t AS t, unnest(range(b+u.f, b+u.t+1)) AS bp FROM gs_part),
 gs_base AS (SELECT transcript, gene, chr, bp, CASE WHEN minus THEN 3-k ELSE k+1 END AS exon, i, i//3+1 AS codon_no, CASE WHEN minus THEN translate(c,'ACGT','TGCA') ELSE c END AS base FROM (SELECT *, substr(g, bp-s0+1, 1) AS c,
 row_number() OVER (PARTITION BY transcript ORDER BY CASE WHEN minus THEN -bp ELSE bp END)-1 AS i FROM gs_each) e),
 gs_seen AS (SELECT b.transcript, b.chr, b.bp, string_agg(concat(CASE b.i%3 WHEN 0 THEN concat(v.alt,'..') WHEN 1 THEN concat('.',v.alt,'.') ELSE concat('..',v.alt) END, '|A/U=', v.a_ac, ':', v.u_ac, '|', coalesce(n.what,'.')), ' ' ORDER BY v.var_id) AS seen
 FROM gs_base b JOIN vc v ON v.chr=b.chr AND v.bp1=b.bp LEFT JOIN (SELECT var_id, transcript, array_to_string(list_sort(list_distinct(list(concat(type, CASE WHEN protein IS NULL THEN '' ELSE concat('|',protein) END)))), ',') AS what FROM an WHERE transcript IS NOT NULL GROUP BY 1, 2) n
 ON n.var_id=v.var_id AND n.transcript=b.transcript GROUP BY 1, 2, 3),
 gs_feat AS (SELECT b.transcript, b.codon_no, array_to_string(list_sort(list_distinct(list(concat(p.source,':',p.feature)))), ',') AS features FROM gs_base b JOIN g_prot p ON p.transcript=b.gene AND p.chr=b.chr AND b.bp BETWEEN p.bp1 AND p.bp2 WHERE b.i%3=2 GROUP BY 1, 2)
SELECT transcript, gene, codon_no,""")


def through_bcf(s: Study) -> tuple[DataFrame, DataFrame]:
    """The study's sites and calls of two chromosomes between two bases, written as BCF and read back by range."""
    spark = s.variants.sparkSession
    path = fresh(spark, "bcf")
    people = [r[0] for r in s.indiv.select(F.col("indiv_id").cast("string")).orderBy("indiv_id").collect()]  # a BCF's header names them all
    B.write_bcf(s.variants, s.geno, people, path, 100)
    variants, calls, _ = B.bcf(spark, path)
    return tuple(t.where("chr in (2, 11) and bp1 >= 1100 and bp1 <= 3000") for t in (variants, calls))


query("bcf_sites", lambda s: through_bcf(s)[0].select("chr", "bp1", "bp2", "name", "ref", "alt", "qual", "filter"),
    "SELECT chr, bp1, bp1+length(ref)-1 AS bp2, name, ref, alt, round(CAST(CAST(qual AS FLOAT) AS DOUBLE),6) AS qual, filter FROM g_variants WHERE chr IN (2,11) AND bp1 BETWEEN 1100 AND 3000")
query("bcf_calls", lambda s: through_bcf(s)[1].groupBy("chr", "bp1", "indiv_id").agg(F.max("ac").alias("ac"), F.max("is_null").alias("lost")).where("ac > 0 or lost").select("chr", "bp1", F.col("indiv_id").cast("long").alias("indiv_id"), "ac", "lost"),
    "SELECT chr, bp1, indiv_id, CAST(max(ac) AS INT) AS ac, max(CAST(ac IS NULL AS INT))=1 AS lost FROM g_variants v JOIN g_geno g ON v.var_id=g.var_id WHERE chr IN (2,11) AND bp1 BETWEEN 1100 AND 3000 GROUP BY 1, 2, 3")

_CARRIED = "filter(g, x -> x.ac > 0)"
query("mask_g_include", lambda s: mask(s, {"include": "size(filter(g, x -> x.gq >= 90 and x.aff = 2)) >= 2 and size(g) < n / 60"}).variants.select("var_id", "chr", "bp1"),
    """SELECT var_id, chr, bp1 FROM vc v WHERE (SELECT count(*) FROM g_geno g JOIN (SELECT var_id, indiv_id, max(gq) AS gq FROM g_calls GROUP BY 1, 2) k ON k.var_id=g.var_id AND k.indiv_id=g.indiv_id JOIN g_indiv i ON i.indiv_id=g.indiv_id
 WHERE g.var_id=v.var_id AND gq>=90 AND aff=2)>=2 AND (SELECT count(*) FROM g_geno g WHERE g.var_id=v.var_id)<n/60.0""")
query("mask_g_eval", lambda s: mask(s, {"eval": {"qt": f"try_divide(aggregate({_CARRIED}, 0D, (t, x) -> t + x.qt), size({_CARRIED}))", "share": "aggregate(g, 0L, (t, x) -> t + coalesce(x.ac, 0)) / (2D * n)", "deep": "array_max(transform(g, x -> x.dp))"}})
    .variants.select("var_id", "qt", "share", F.col("deep").cast("double").alias("deep")), """SELECT v.var_id, round(avg(qt) FILTER (ac>0),6) AS qt, round(coalesce(sum(ac),0)/(2.0*max(n.n)),6) AS share, round(CAST(max(dp) AS DOUBLE),6) AS deep
 FROM g_variants v CROSS JOIN n LEFT JOIN (SELECT g.var_id AS var, ac, qt, dp FROM g_geno g JOIN (SELECT var_id, indiv_id, max(dp) AS dp FROM g_calls GROUP BY 1, 2) k ON k.var_id=g.var_id AND k.indiv_id=g.indiv_id
 JOIN g_indiv i ON i.indiv_id=g.indiv_id) x ON x.var=v.var_id GROUP BY 1""")

query("glm_robust", lambda s: A.glm_robust(s).select("var_id", "n", "beta", "se", "robust", "low", "high"), """SELECT var_id, n, round(beta,6) AS beta, round(se,6) AS se, round(robust,6) AS robust, round(beta-1.959963984540054*robust,6) AS low, round(beta+1.959963984540054*robust,6) AS high FROM (
 SELECT var_id, CAST(n AS BIGINT) AS n, beta, sqrt(greatest(syy-beta*sxy,0)/(n-2)/sxx) AS se, sqrt(meat)/sxx AS robust FROM (SELECT a.var_id, n, sxx, sxy, syy, beta, sum((x-mx)*(x-mx)*(y-my-beta*(x-mx))*(y-my-beta*(x-mx))) AS meat FROM each a
 JOIN (SELECT *, sxy/sxx AS beta FROM (SELECT var_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum((x-ax)*(x-ax)) AS sxx, sum((x-ax)*(y-ay)) AS sxy, sum((y-ay)*(y-ay)) AS syy FROM (SELECT *, avg(x) OVER w AS ax, avg(y) OVER w AS ay FROM each WINDOW w AS (PARTITION BY var_id)) c GROUP BY 1) m WHERE sxx>1e-9 AND n>2) f
 ON f.var_id=a.var_id GROUP BY ALL) q) z""")
SQL["glm_robust"] = SQL["glm_robust"].replace("\nSELECT var_id, n, round(", """, each AS (SELECT v.var_id, CAST(coalesce(g.ac, 0) AS DOUBLE) AS x, i.qt AS y FROM (SELECT DISTINCT var_id FROM g_geno) v CROSS JOIN g_indiv i
 LEFT JOIN g_geno g ON g.var_id=v.var_id AND g.indiv_id=i.indiv_id WHERE i.qt IS NOT NULL AND NOT (g.var_id IS NOT NULL AND g.ac IS NULL))\nSELECT var_id, n, round(""")
query("residuals", lambda s: A.residuals(s, ("strata",)), """SELECT indiv_id, round(qt-my-slope*(strata-mx),6) AS residual FROM g_indiv, (SELECT regr_slope(qt, strata) AS slope, avg(qt) AS my, avg(strata) AS mx FROM g_indiv) r""")


def annotations_of_sites(s: Study) -> DataFrame:
    """A table by site, with several rows of some: what a file of site annotations gives."""
    return s.refs.select("chr", "bp1", F.concat("grp", F.lit("_"), "name").alias("label"), F.length("alt").cast("long").alias("width"))


query("mask_meta_file", lambda s: mask(s, {"meta.file": [annotations_of_sites(s)], "include": "label like 'A%' and width < 2"}).variants.select("var_id", "label", "width"),
    """SELECT var_id, label, width FROM g_variants v JOIN (SELECT chr, bp1, concat(grp,'_',name) AS label, CAST(length(alt) AS BIGINT) AS width FROM g_ref QUALIFY row_number() OVER (PARTITION BY chr, bp1 ORDER BY concat(grp,'_',name), length(alt))=1) f
 ON f.chr=v.chr AND f.bp1=v.bp1 WHERE label LIKE 'A%' AND width<2""")  # fmt: skip

_RSQ = "SELECT site_id, count(*) AS n, round(avg(t),6) AS aaf, round(CASE WHEN avg(t)*(1-avg(t))>0 THEN 2*var_pop(t)/(avg(t)*(1-avg(t))) ELSE 0 END,6) AS rsq FROM (SELECT site_id, {} AS t FROM r_geno) x GROUP BY 1"
record_query("imputation_r2", lambda r: S.rounded(G.imputation_quality(r.genotypes.select("site_id", "dosage"), "site_id")), _RSQ.format("dosage/2"))
record_query("imputation_r2_posterior", lambda r: S.rounded(G.imputation_quality(r.genotypes.select("site_id", *[F.expr(f"l{k} / (l0 + l1 + l2)").alias(f"p{k}") for k in range(3)]), "site_id")), _RSQ.format("(l1+2*l2)/(l0+l1+l2)/2"))

query("loc_name_intersect", L.name_intersection, "SELECT altname, count(*) FILTER (group_id=0) AS a, count(*) FILTER (group_id=1) AS b FROM g_loci GROUP BY 1 HAVING count(*) FILTER (group_id=0)>0 AND count(*) FILTER (group_id=1)>0")
query("loc_group_span", L.group_span, "SELECT group_id, chr, min(bp1) AS bp1, max(bp2) AS bp2, min(bp1)+(max(bp2)-min(bp1))//2 AS midpoint, count(*) AS n FROM g_loci GROUP BY 1, 2")
query("ref_range", lambda s: L.ref_range(s, 5), """SELECT var_id, grp, count(*) AS n, array_to_string(list_sort(list_distinct(list(name))), ',') AS names FROM (SELECT v.var_id, r.grp, r.name FROM g_variants v JOIN g_ref r ON r.chr=v.chr AND r.bp1 BETWEEN v.bp1-5 AND v.bp1+length(v.ref)+4) x GROUP BY 1, 2""")
