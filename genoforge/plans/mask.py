"""Masks: terms that choose individuals, genotypes and variants of a study.

Terms come as a dictionary in the same spelling as on a command line, e.g.
mask(study, {"loc": [1], "maf": "0:0.05", "any.filter.ex": True}). Include terms are alternatives, require and
exclude terms all hold. Conditions on meta-fields (include, v-include, eval, geno) are Spark SQL expressions.
People go first, then genotypes, then sites, and what needs counts last, so counts are made of what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import allele_type, in_range, in_region, is_region
from ..operators.annotation import annotate, worst
from ..operators.intervals import points_in
from .study import PIECE, Study, consensus, counted, with_hwe


def _list(x) -> list:
    return list(x) if isinstance(x, Iterable) and not isinstance(x, str) else [x]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _filters(names: list[str]) -> Column:
    return _any([F.array_contains(F.split("filter", ";"), n) for n in names])


def _template(text: str) -> Column:
    """`REF/ALT` with `*` for anything and `?` for any one base; both must match in the same template."""
    def like(c: str, t: str) -> Column:
        return F.lit(True) if t == "*" else F.col(c).like(t.replace("?", "_"))

    ref, _, alt = text.partition("/")
    return like("ref", ref) & like("alt", alt or "*")


def _exactly(regions) -> list[Column]:
    return [is_region(r, F.col("chr"), F.col("bp1"), F.col("bp1") + F.length("ref") - 1) for r in _list(regions)]


def _some(*kinds: str) -> Column:
    """An ALT is of one of these kinds."""
    return F.exists(F.split("alt", ","), lambda a: allele_type(F.col("ref"), a).isin(*kinds))


def _snp() -> Column:
    """All ALTs are substitutions of one base."""
    return F.forall(F.split("alt", ","), lambda a: allele_type(F.col("ref"), a) == "substitution")


#: Terms on a variant's own columns.
SITE: dict[str, Callable[..., Column]] = {
    "qual": lambda x: in_range(F.col("qual"), x, 1),
    "filter": lambda x: _filters(_list(x)), "filter.ex": lambda x: ~_filters(_list(x)), "filter.req": lambda x: _all([_filters([n]) for n in _list(x)]),
    "any.filter": lambda x: F.col("filter") != "PASS", "any.filter.req": lambda x: F.col("filter") != "PASS", "any.filter.ex": lambda x: F.col("filter") == "PASS",
    "include": lambda x: F.coalesce(F.expr(x), F.lit(False)), "v-include": lambda x: F.coalesce(F.expr(x), F.lit(False)), "exclude": lambda x: F.coalesce(~F.expr(x), F.lit(False)),
    "snp": lambda x: _snp(), "snp.ex": lambda x: ~_snp(), "indel": lambda x: _some("insertion", "deletion"), "indel.ex": lambda x: ~_some("insertion", "deletion"), "mnp": lambda x: _some("mnp"), "mnp.ex": lambda x: ~_some("mnp"),
    "biallelic": lambda x: ~F.col("alt").contains(",") & (allele_type(F.col("ref"), F.col("alt")) != "unknown"),
    "biallelic.ex": lambda x: F.col("alt").contains(",") | (allele_type(F.col("ref"), F.col("alt")) == "unknown"),
    "allele": lambda x: _any([_template(t) for t in _list(x)]), "allele.ex": lambda x: ~_any([_template(t) for t in _list(x)]),
    "novel": lambda x: F.col("name") == ".", "novel.ex": lambda x: F.col("name") != ".",
    "meta": lambda x: _any([_criterion(c) for c in _list(x)]), "meta.req": lambda x: _all([_criterion(c) for c in _list(x)]),
    "reg.req": lambda x: _all([in_region(r, F.col("chr"), F.col("bp1")) for r in _list(x)]), "reg.ex": lambda x: ~_any([in_region(r, F.col("chr"), F.col("bp1")) for r in _list(x)]),
    "ereg.req": lambda x: _all(_exactly(x)), "ereg.ex": lambda x: ~_any(_exactly(x)),
    "id.req": lambda x: F.col("name").isin(_list(x)), "id.ex": lambda x: ~F.col("name").isin(_list(x)),
}

#: Terms on counts, see study.counted().
COUNTS: dict[str, Callable[..., Column]] = {
    "mac": lambda x: in_range(F.col("mac"), x), "maf": lambda x: in_range(F.col("maf"), x), "aac": lambda x: in_range(F.col("ac"), x), "aaf": lambda x: in_range(F.col("aaf"), x),
    "monomorphic": lambda x: (F.col("tot") > 0) & ((F.col("ac") == 0) | (F.col("ac") == F.col("tot"))), "monomorphic.ex": lambda x: ~((F.col("tot") > 0) & ((F.col("ac") == 0) | (F.col("ac") == F.col("tot")))),
    "hwe": lambda x: in_range(F.col("hwe"), x, 1), "null": lambda x: in_range(F.col("nul"), x, -1), "null.prop": lambda x: in_range(F.col("nul") / F.col("n"), x, -1),
    # The minor allele is chosen among cases and among controls separately.
    "case.control": lambda x: in_range(F.least("a_ac", F.col("a_tot") - F.col("a_ac")), _list(x)[0]) & in_range(F.least("u_ac", F.col("u_tot") - F.col("u_ac")), _list(x)[1]),
    "case.uniq": lambda x: (F.least("a_ac", F.col("a_tot") - F.col("a_ac")) >= 1) & (F.least("u_ac", F.col("u_tot") - F.col("u_ac")) == 0),
    "control.uniq": lambda x: (F.least("a_ac", F.col("a_tot") - F.col("a_ac")) == 0) & (F.least("u_ac", F.col("u_tot") - F.col("u_ac")) >= 1),
}

#: Terms on the files that a variant is seen in, see _files().
FILES: dict[str, Callable[..., Column]] = {
    "obs.file": lambda x: F.arrays_overlap("obs", F.array(*map(F.lit, _list(x)))), "obs.file.req": lambda x: _all([F.array_contains("obs", f) for f in _list(x)]), "obs.file.ex": lambda x: ~F.arrays_overlap("obs", F.array(*map(F.lit, _list(x)))),
    "alt.file": lambda x: F.arrays_overlap("alts", F.array(*map(F.lit, _list(x)))), "alt.file.req": lambda x: _all([F.array_contains("alts", f) for f in _list(x)]), "alt.file.ex": lambda x: ~F.arrays_overlap("alts", F.array(*map(F.lit, _list(x)))),
    "obs.nfile": lambda x: in_range(F.size("obs"), x, 1), "alt.nfile": lambda x: in_range(F.size("alts"), x, 1),
}

#: Include terms by name, with the require and exclude terms of the same tables.
TABLES = ("loc", "gene", "locset", "ref", "var", "varset")

PEOPLE = ("indiv", "indiv.ex", "phe", "phe.ex", "phe.req", "phe.obs", "phe.allow.missing")
GENOTYPES = ("file", "file.ex", "geno", "geno.req", "assume-ref", "seg", "seg.req", "seg.ex")
INCLUDES = ("loc", "gene", "locset", "ref", "var", "varset", "reg", "ereg", "id")
#: Terms that name the groups of the result, see Study.groups; and terms that the evaluator takes as true.
GROUPS, VOID = ("loc.group", "locset.group", "varset.group", "all.group", "empty.group"), ("alt.group", "alt.group.req", "alt.group.ex")
ATTACHED = ("meta.attach", "meta.file", "annot.append", "fail.nfile", "fail.single.file")
REFINING = ("loc.subset", "loc.skip", "locset.subset", "locset.skip", "limit", "eval", "loc.append", "locset.append", "var.append", "varset.append", "ref.append", "ref.allelic", "collapse", "no-geno", "no-vmeta", "no-gmeta", "load-vmeta")
TERMS = sorted({*SITE, *COUNTS, *FILES, *PEOPLE, *GENOTYPES, *INCLUDES, *REFINING, *GROUPS, *VOID, *ATTACHED, *(f"{t}.{k}" for t in TABLES if t != "gene" for k in ("req", "ex"))})


def _criterion(text: str) -> Column:
    """`TAG:op:value` with op eq, ne, not, is, gt, ge, lt, le, and `TAG:set`."""
    tag, op, *value = text.split(":")
    c = F.col(tag)
    if op == "set":
        return c.isNotNull()
    v = value[0]
    try:
        v = float(v)
    except ValueError:
        pass
    return F.coalesce({"eq": c == v, "is": c == v, "ne": c != v, "not": c != v, "gt": c > v, "ge": c >= v, "lt": c < v, "le": c <= v}[op], F.lit(False))


def _pheno(study: Study, text: str) -> DataFrame:
    """(indiv_id) of the people with one of the values of `name:v1:v2`, or with any for a bare name."""
    name, *values = str(text).split(":")
    rows = study.pheno.where((F.col("pheno") == name) & F.col("value").isNotNull())
    return (rows.where(_any([_same(F.col("value"), v) for v in values])) if values else rows).select("indiv_id").distinct()


def _same(value: Column, text: str) -> Column:
    """Values are compared as numbers where the text is one, else as texts."""
    try:
        return value.cast("double") == float(text)
    except ValueError:
        return value.cast("string") == text


def _people(study: Study, terms: dict) -> DataFrame:
    indiv = study.indiv
    if "indiv" in terms:
        indiv = indiv.where(F.col("indiv_id").isin(_list(terms["indiv"])))
    if "indiv.ex" in terms:
        indiv = indiv.where(~F.col("indiv_id").isin(_list(terms["indiv.ex"])))
    if "phe" in terms:
        indiv = indiv.join(reduce(DataFrame.union, [_pheno(study, p) for p in _list(terms["phe"])]).distinct(), "indiv_id", "left_semi")
    for p in _list(terms.get("phe.req", [])):
        indiv = indiv.join(_pheno(study, p), "indiv_id", "left_semi")
    for p in _list(terms.get("phe.ex", [])):
        indiv = indiv.join(_pheno(study, p), "indiv_id", "left_anti")
    if "phe.obs" in terms and not terms.get("phe.allow.missing"):
        indiv = indiv.join(_pheno(study, terms["phe.obs"]), "indiv_id", "left_semi")
    return indiv


def _genotypes(study: Study, terms: dict) -> Study:
    calls, geno = study.calls, study.geno
    if "file" in terms or "file.ex" in terms:
        calls = calls.where(F.col("file_id").isin(_list(terms["file"])) if "file" in terms else F.lit(True))
        calls = calls.where(~F.col("file_id").isin(_list(terms["file.ex"])) if "file.ex" in terms else F.lit(True))
        geno = consensus(calls)
    tests = [how([_criterion(c) for c in _list(terms[t])]) for t, how in (("geno", _any), ("geno.req", _all)) if t in terms]
    if tests:
        calls = calls.withColumn("is_null", F.col("is_null") | ~_all(tests))
        geno = consensus(calls)
    for name, how in (("seg", "any"), ("seg.req", "all"), ("seg.ex", "none")):
        if name in terms:  # (indiv_id, chr, bp1, bp2) segments; outside (seg.ex: inside) them the genotype is missing
            for segments in _list(terms[name]):
                sites = geno.join(study.variants.select("var_id", "chr", "bp1"), "var_id")
                inside = points_in(sites, segments).where(F.col("indiv_id") == F.col("i_indiv_id")).select("var_id", "indiv_id").distinct().withColumn("_in", F.lit(True))
                here = F.col("_in").isNotNull()
                geno = geno.join(inside, ["var_id", "indiv_id"], "left").select("var_id", "indiv_id", F.when(~here if how == "none" else here, F.col("ac")).alias("ac"))
    if terms.get("assume-ref"):
        geno = geno.where("ac is not null")
    if terms.get("collapse"):
        geno = geno.withColumn("ac", F.least("ac", F.lit(2)))
    return study.but(calls=calls, geno=geno)


def _loci(study: Study, terms: dict, groups) -> DataFrame:
    loci = study.loci.where(F.col("group_id").isin(_list(groups)))
    if "loc.subset" in terms:
        loci = loci.where(F.col("altname").isin(_list(terms["loc.subset"])))
    if "loc.skip" in terms:
        loci = loci.where(~F.col("altname").isin(_list(terms["loc.skip"])))
    return loci


def _members(study: Study, terms: dict, kind: str, value) -> DataFrame:
    """(var_id) of the variants that a table term names."""
    v = study.variants
    if kind == "loc":
        return points_in(v, _loci(study, terms, value)).select("var_id").distinct()
    if kind == "gene":
        return points_in(v, study.loci.where(F.col("altname").isin(_list(value)))).select("var_id").distinct()
    if kind == "locset":
        sets = study.sets.where(F.col("set_name").isin(_list(value)))
        return points_in(v, study.loci.join(sets.select("loc_id"), "loc_id", "left_semi")).select("var_id").distinct()
    if kind == "ref":
        keys = ["chr", "bp1", "alt"] if terms.get("ref.allelic") else ["chr", "bp1"]
        return v.join(study.refs.where(F.col("grp").isin(_list(value))).select(keys).distinct(), keys, "left_semi").select("var_id")
    column = "set_name" if kind == "var" else "superset_name"
    return study.var_sets.where(F.col(column).isin(_list(value))).select("var_id").distinct()


def _appended(study: Study, terms: dict, variants: DataFrame) -> DataFrame:
    if "loc.append" in terms:
        met = points_in(variants, _loci(study, terms, terms["loc.append"])).groupBy("var_id").agg(F.array_sort(F.collect_set("i_altname")).alias("loc_names"))
        variants = variants.join(met, "var_id", "left")
    if "locset.append" in terms:
        sets = study.loci.join(study.sets.where(F.col("superset_name").isin(_list(terms["locset.append"]))), "loc_id")
        met = points_in(variants, sets).groupBy("var_id").agg(F.array_sort(F.collect_set("i_set_name")).alias("locset_names"))
        variants = variants.join(met, "var_id", "left")
    for term, column in (("var.append", "set_name"), ("varset.append", "superset_name")):
        if term in terms:
            met = study.var_sets.where(F.col(column).isin(_list(terms[term]))).groupBy("var_id").agg(F.array_sort(F.collect_set("set_name")).alias(term.replace(".append", "_names")))
            variants = variants.join(met, "var_id", "left")
    if "ref.append" in terms:
        keys = ["chr", "bp1", "alt"] if terms.get("ref.allelic") else ["chr", "bp1"]
        met = study.refs.where(F.col("grp").isin(_list(terms["ref.append"]))).groupBy(*keys).agg(F.array_sort(F.collect_set("name")).alias("ref_names"))
        variants = variants.join(met, keys, "left")
    return variants


def _attached(study: Study, terms: dict, variants: DataFrame) -> DataFrame:
    """variants with what is attached before any condition reads it.

    meta.attach names groups of study.metas, or ALL: their fields are a map column `attached`. meta.file takes tables
    (chr, bp1, field ...), each joined by site with its fields as columns. annot.append gives each variant its worst
    consequence `func`, the genes that it has it in as `gene`, and `annot_full`. Expressions that name `g` or `n` get genotypes.
    """
    if "meta.attach" in terms:
        groups = _list(terms["meta.attach"])
        rows = study.metas if "ALL" in groups else study.metas.where(F.col("grp").isin(groups))
        one = rows.groupBy("var_id", "key").agg(F.min("value").alias("value"))
        maps = one.groupBy("var_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("attached"))
        variants = variants.join(maps, "var_id", "left")
    if terms.get("annot.append"):
        variants = variants.join(worst(annotate(variants, study.transcripts, study.reference, PIECE)).drop("n"), "var_id", "left")
    if any(re.search(r"\b[gn]\b", text) for text in _texts(terms)):
        variants = with_genotypes(study, variants)
    for table in _list(terms.get("meta.file", [])):
        fields = [c for c in table.columns if c not in ("chr", "bp1")]
        first = table.groupBy("chr", "bp1").agg(F.min(F.struct(*fields)).alias("_f")).select("chr", "bp1", *[F.col("_f")[c].alias(c) for c in fields])  # of several rows of a site the least
        variants = variants.join(first, ["chr", "bp1"], "left")
    return variants


def _texts(terms: dict) -> list[str]:
    """The expressions over a variant's fields."""
    return [str(x) for t in ("include", "v-include") for x in _list(terms.get(t, []))] + [str(x) for x in dict(terms.get("eval", {})).values()]


def with_genotypes(study: Study, variants: DataFrame) -> DataFrame:
    """variants with `g`, their stored genotypes in order of people, and `n`, the number of people.

    An element has indiv_id, ac (null is missing), dp and gq (the largest over files) and the person's sex, aff, qt, strata
    and factor. Reference homozygotes are no elements: `n - size(g)` people have an ac of 0. A variant's
    array grows with its carriers, so mask by frequency first where many people carry it.
    """
    depth = study.calls.groupBy("var_id", "indiv_id").agg(F.max("dp").alias("dp"), F.max("gq").alias("gq"))
    person = study.indiv.select("indiv_id", "sex", "aff", "qt", "strata", "factor")
    cells = study.geno.join(variants.select("var_id"), "var_id", "left_semi").join(person, "indiv_id").join(depth, ["var_id", "indiv_id"], "left")
    g = cells.groupBy("var_id").agg(F.sort_array(F.collect_list(F.struct("indiv_id", "ac", "dp", "gq", "sex", "aff", "qt", "strata", "factor"))).alias("g"))
    n = F.broadcast(study.indiv.agg(F.count(F.lit(1)).alias("n")))  # one row
    none = F.array().cast(g.schema["g"].dataType)
    return variants.join(g, "var_id", "left").withColumn("g", F.coalesce("g", none)).crossJoin(n)


def _failing(study: Study, terms: dict, variants: DataFrame) -> DataFrame:
    """variants by how many files' records of them fail: fail.nfile `n:m` takes n failing at most and m good at least."""
    fails = F.count(F.when(F.col("filter") != "PASS", 1))
    seen = study.sites.groupBy("var_id").agg(fails.alias("_bad"), (F.count(F.lit(1)) - fails).alias("_good"))
    keep = variants.join(seen, "var_id", "left").fillna(0, ["_bad", "_good"])
    if "fail.nfile" in terms:
        most, _, least = str(terms["fail.nfile"]).replace("-", ":").partition(":")
        keep = keep.where((F.col("_bad") <= int(most)) & (F.col("_good") >= int(least or 0)))
    if terms.get("fail.single.file"):
        keep = keep.where("_bad = 0")
    return keep.select(variants.columns)


def mask(study: Study, terms: dict) -> Study:
    """The study with the people, genotypes and variants that the terms leave, and with the groups that they name."""
    if unknown := set(terms) - set(TERMS):
        raise ValueError(f"unknown mask terms: {sorted(unknown)}")
    study = study.but(indiv=_people(study, terms))
    study = _genotypes(study, terms)
    v = _attached(study, terms, study.variants)
    # A FILTER requirement that holds makes include terms void.
    free = [SITE["filter.req"](terms["filter.req"])] if "filter.req" in terms else []
    for t, value in terms.items():
        if t in SITE:
            v = v.where(SITE[t](value))
    for kind in TABLES:
        for value in _list(terms.get(f"{kind}.req", [])):
            v = v.join(_members(study, terms, kind, value), "var_id", "left_semi")
        if f"{kind}.ex" in terms:
            v = v.join(_members(study, terms, kind, terms[f"{kind}.ex"]), "var_id", "left_anti")
    wanted = []
    for kind in ("reg", "ereg"):
        if kind in terms:
            here = _exactly(terms[kind]) if kind == "ereg" else [in_region(r, F.col("chr"), F.col("bp1")) for r in _list(terms[kind])]
            wanted.append(v.where(_any(here)).select("var_id"))
    if "id" in terms:
        wanted.append(v.where(F.col("name").isin(_list(terms["id"]))).select("var_id"))
    wanted += [_members(study.but(variants=v), terms, kind, terms[kind]) for kind in TABLES if kind in terms]
    if wanted and not free:
        v = v.join(reduce(DataFrame.union, wanted).distinct(), "var_id", "left_semi")
    if any(t in FILES for t in terms):
        seen = study.calls.groupBy("var_id").agg(F.collect_set("file_id").alias("obs"), F.collect_set(F.when(~F.col("is_null") & (F.col("ac") > 0), F.col("file_id"))).alias("alts"))
        v = v.join(seen, "var_id").where(_all([FILES[t](x) for t, x in terms.items() if t in FILES])).select(v.columns)
    if "fail.nfile" in terms or terms.get("fail.single.file"):
        v = _failing(study, terms, v)
    if any(t in COUNTS for t in terms):
        counts = counted(study.but(variants=v))
        counts = with_hwe(counts) if "hwe" in terms else counts
        v = counts.where(_all([COUNTS[t](x) for t, x in terms.items() if t in COUNTS])).select(v.columns)
    v = _appended(study, terms, v)
    for name, expression in dict(terms.get("eval", {})).items():
        v = v.withColumn(name, F.expr(expression))
    v = v.drop("g", "n")
    if "load-vmeta" in terms or terms.get("no-vmeta"):
        v = v.select("var_id", "chr", "bp1", "name", "ref", "alt", *_list(terms.get("load-vmeta", [])))
    if "limit" in terms:
        v = v.orderBy("chr", "bp1", "var_id").limit(int(terms["limit"]))
    geno = study.geno.where("false") if terms.get("no-geno") else study.geno
    kept = geno.join(v.select("var_id"), "var_id", "left_semi").join(study.indiv.select("indiv_id"), "indiv_id", "left_semi")
    study = study.but(variants=v, geno=kept)
    for term, by in (("loc.group", "loc"), ("locset.group", "locset"), ("varset.group", "varset"), ("all.group", "all")):
        if terms.get(term):
            own = study.but(loci=_loci(study, terms, terms[term])) if by == "loc" else study
            names = _list(terms[term]) if by in ("locset", "varset") and terms[term] is not True else None
            study = study.but(groups=grouped(own, by, names, bool(terms.get("empty.group"))))
    return study


def grouped(study: Study, by: str = "loc", names: list | None = None, empty: bool = False) -> DataFrame:
    """(group, var_id): variants by locus altname, locus set, variant set or all as one; a variant is in every group that holds it."""
    if by == "all":
        return study.variants.select(F.lit("all").alias("group"), "var_id")
    if by == "varset":
        rows = study.var_sets.select(F.col("set_name").alias("group"), "var_id").join(study.variants.select("var_id"), "var_id", "left_semi").select("group", "var_id")
        every = study.var_sets.select(F.col("set_name").alias("group")).distinct()
    else:
        loci = study.loci.withColumn("group", F.col("altname")) if by == "loc" else study.loci.join(study.sets, "loc_id").withColumn("group", F.col("set_name"))
        rows = points_in(study.variants, loci.select("chr", "bp1", "bp2", "group")).select(F.col("i_group").alias("group"), "var_id").distinct()
        every = loci.select("group").distinct()
    if names:
        rows, every = rows.where(F.col("group").isin(names)), every.where(F.col("group").isin(names))
    return every.join(rows, "group", "left") if empty else rows
