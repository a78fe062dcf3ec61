"""What a variant does to each transcript that it meets, from exons, coding parts and reference pieces.

Coding coordinates come from running sums over a transcript's coding parts in reading direction; its sequence is put
together from reference pieces that meet them. Variants meet transcripts by an interval join that carries their
bounds only; exons join what met, sequences the coding changes alone. What met is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.study import PIECE, Study, counted
from ..sources.scratch import kept
from .intervals import overlaps
from .loci import AMINO_ACIDS, reverse_complement
from .summaries import counts

#: Bases at an exon's end that belong to the splice site, and those of the intron that are kept for them.
SPLICE, FLANK = 5, 40

# Classes of consequences from the worst to the mildest.
CLASSES = ["frameshift", "nonsense", "start-lost", "esplice", "csplice", "readthrough", "codon-insertion", "codon-deletion", "missense",
           "indel", "splice", "exonic-unknown", "silent", "UTR5", "UTR3", "npcRNA", "intronic", "intergenic"]
# The classes of which several make a variant `mixed`, as far as they can occur under these names.
MIXED = ["silent", "missense", "nonsense", "esplice", "csplice", "splice", "readthrough", "intergenic", "frameshift", "npcRNA"]
# The consequences of a class that has another name, or several.
CLASS_OF = {
    "stop-insertion": "nonsense", "read-through": "readthrough", "stop-deletion": "readthrough", "out-of-frame-codon-deletion": "codon-deletion",
    "out-of-frame-codon-insertion": "codon-insertion", "splice-donor-ex2ag": "csplice", "splice-donor-in45ag": "csplice", "splice-acceptor-ex1g": "csplice",
    "splice-donor-in2": "esplice", "splice-acceptor-in2": "esplice", "splice-deletion": "esplice", "5-UTR": "UTR5", "3-UTR": "UTR3", "intergenic-region": "intergenic",
}


def codons(seq: Column) -> Column:
    """The codons of a sequence from its first base; bases that lack at its end are `-`."""
    whole = F.rpad(seq, (F.ceil(F.length(seq) / 3) * 3).cast("int"), F.lit("-"))
    return F.when(F.length(seq) == 0, F.array().cast("array<string>")).otherwise(F.regexp_extract_all(whole, F.lit("(...)"), F.lit(1)))


def amino(codon: Column) -> Column:
    """A codon's amino acid: `x` if bases lack, `?` if one isn't A, C, G or T."""
    digits = F.translate(codon, "TCAG", "0123")
    code = F.when(digits.rlike("^[0-3]{3}$"), F.substring(F.lit(AMINO_ACIDS), F.conv(digits, 4, 10).cast("int") + 1, F.lit(1)))
    return F.when(codon.contains("-"), "x").otherwise(F.coalesce(code, F.lit("?")))


def sequences(parts: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    """(part columns, seq): the reference from bp1 to bp2, in upper case, of parts (chr, bp1, bp2); pieces (chr, piece, seq) hold `width` bases from piece * width on. Bases without a piece are N."""
    keyed = parts.withColumn("_id", F.xxhash64(*parts.columns))
    met = keyed.select("_id", "chr", "bp1", "bp2", F.explode(F.sequence(F.floor(F.col("bp1") / width), F.floor(F.col("bp2") / width))).alias("piece")).distinct()
    whole = F.rpad(F.upper(F.coalesce("seq", F.lit(""))), width, F.lit("N"))
    low, high = F.greatest("bp1", F.col("piece") * width), F.least("bp2", (F.col("piece") + 1) * width - 1)
    cut = F.substring(whole, (low - F.col("piece") * width + 1).cast("int"), (high - low + 1).cast("int"))
    joined = met.join(pieces.select("chr", "piece", "seq"), ["chr", "piece"], "left").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("piece", cut.alias("cut")))).alias("cuts"))
    return keyed.join(joined, "_id").withColumn("seq", F.array_join("cuts.cut", "")).drop("_id", "cuts")


def transcripts(parts: DataFrame, pieces: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Exon tables and coding sequences of parts (transcript, gene, kind, chr, bp1, bp2, strand, frame).

    (transcript, gene, chr, bp1, bp2, minus, exons (first, last, before, inside), cds (first, last, offset)), and
    (transcript, seq, frame): `offset` is the number of coding bases before the part in reading direction, `before` and
    `inside` the bases on either side of each exon end, as far as FLANK. Transcripts on no or both strands, or with a
    stop codon for all coding part, are left out. kind: exon, CDS or stop_codon.
    """
    good = parts.groupBy("transcript", "chr").agg(F.min("gene").alias("gene"), F.min("bp1").alias("t1"), F.max("bp2").alias("t2"),
        F.min("strand").alias("low"), F.max("strand").alias("high"), F.max(F.when(F.col("kind") == "CDS", 1)).alias("coding"), F.max(F.when(F.col("kind") == "stop_codon", 1)).alias("stop"),
        F.max(F.when(F.col("kind") == "exon", 1)).alias("exon")).where("low = high and low in ('+', '-') and (coding = 1 or stop is null) and exon = 1")
    minus = F.col("low") == "-"
    exon = parts.where("kind = 'exon'").select("transcript", "chr", "bp1", "bp2").distinct()
    ends = exon.select("transcript", "chr", F.explode(F.array(F.struct(F.col("bp1").alias("end"), F.lit(0).alias("side")), F.struct(F.col("bp2").alias("end"), F.lit(1).alias("side")))).alias("e")).select("transcript", "chr", "e.*")
    around = ends.select("transcript", "chr", "end", "side", F.greatest(F.col("end") - FLANK, F.lit(0)).alias("bp1"), (F.col("end") + FLANK).alias("bp2")).distinct()
    flanks = sequences(around, pieces, width).select("transcript", "chr", "end", "side", F.col("bp1").alias("from"), "seq")
    first = exon.join(flanks.where("side = 0").select("transcript", "chr", F.col("end").alias("bp1"), F.col("seq").alias("seq1"), F.col("from").alias("from1")), ["transcript", "chr", "bp1"])
    both = first.join(flanks.where("side = 1").select("transcript", "chr", F.col("end").alias("bp2"), F.col("seq").alias("seq2"), F.col("from").alias("from2")), ["transcript", "chr", "bp2"])
    exons = both.groupBy("transcript", "chr").agg(F.sort_array(F.collect_list(F.struct(F.col("bp1").alias("first"), F.col("bp2").alias("last"), "seq1", "from1", "seq2", "from2"))).alias("exons"))
    cds = parts.where("kind <> 'exon'").select("transcript", "chr", "bp1", "bp2", "strand", "frame").distinct()
    size = F.col("bp2") - F.col("bp1") + 1
    reading = Window.partitionBy("transcript", "chr").orderBy(F.when(F.col("strand") == "-", -F.col("bp1")).otherwise(F.col("bp1")))
    offset = cds.withColumn("offset", F.sum(size).over(reading.rowsBetween(Window.unboundedPreceding, 0)) - size)
    placed = offset.groupBy("transcript", "chr").agg(F.sort_array(F.collect_list(F.struct(F.col("bp1").alias("first"), F.col("bp2").alias("last"), "offset"))).alias("cds"))
    table = good.join(exons, ["transcript", "chr"]).join(placed, ["transcript", "chr"], "left").select(
        "transcript", "gene", "chr", F.col("t1").alias("bp1"), F.col("t2").alias("bp2"), minus.alias("minus"), "exons", F.coalesce("cds", F.array().cast("array<struct<first:bigint,last:bigint,offset:bigint>>")).alias("cds"))
    text = sequences(offset, pieces, width).groupBy("transcript", "chr").agg(F.sort_array(F.collect_list(F.struct("bp1", "seq"))).alias("s"), F.max("strand").alias("strand"), F.min_by("frame", "offset").alias("frame"))
    joined = F.array_join("s.seq", "")
    seqs = text.select("transcript", "chr", F.when(F.col("strand") == "-", reverse_complement(joined)).otherwise(joined).alias("cdna"), F.coalesce("frame", F.lit(0)).alias("frame"))
    return table, seqs


def alleles(variants: DataFrame) -> DataFrame:
    """(var_id, chr, bp1, bp2, alt, r, a): each ALT of variants (var_id, chr, bp1, ref, alt) without the bases that it shares with REF at its begin and, if it is as long as REF, at its end. An insertion lies before bp1."""
    each = variants.select("var_id", "chr", F.col("bp1").alias("_bp"), F.upper("ref").alias("_r"), F.explode(F.array_distinct(F.split(F.upper("alt"), ","))).alias("alt"))
    least = F.least(F.length("_r"), F.length("alt"))
    shared = lambda r, a: F.coalesce(F.array_position(F.zip_with(F.split(r, ""), F.split(a, ""), lambda x, y: F.coalesce(x != y, F.lit(True))), True), F.lit(0))
    first = F.when(F.col("_r") == F.col("alt"), F.when(F.col("_r").isin("N", "."), 0).otherwise(F.length("_r"))).otherwise(shared(F.col("_r"), F.col("alt")) - 1)
    out = each.withColumn("_o", F.least(first, least).cast("int"))
    same = (F.length("_r") == F.length("alt")) & (F.length("_r") > 1) & (F.col("_r") != F.col("alt"))
    out = out.withColumn("_e", F.when(same, shared(F.reverse("_r"), F.reverse("alt")) - 1).otherwise(0).cast("int"))
    cut = lambda c: F.substring(c, F.col("_o") + 1, F.greatest(F.length(c) - F.col("_o") - F.col("_e"), F.lit(0)))
    return out.select("var_id", "chr", "alt", (F.col("_bp") + F.col("_o")).alias("bp1"), cut(F.col("_r")).alias("r"), cut(F.col("alt")).alias("a")).withColumn(
        "bp2", F.col("bp1") + F.greatest(F.length("r"), F.lit(1)) - 1)


#: What is known of a consequence; null where it says nothing.
FIELDS = "type string, cpos bigint, codon string, protein string, ppos bigint, dist bigint, exon bigint, nmd int, ofptv int, pep bigint, newpep bigint, fsx bigint"
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _row(**known: str) -> str:
    """A consequence as SQL; fields that aren't given are null."""
    kinds = dict(f.split() for f in FIELDS.split(", "))
    return "named_struct(" + ", ".join(f"'{n}', cast({known.get(n, 'null')} as {kinds[n]})" for n in _NAMES) + ")"


def _rows(*parts: tuple[str, str]) -> str:
    """Consequences (condition, row), as SQL for an array."""
    return "filter(array(" + ", ".join(f"if({c}, {r}, null)" for c, r in parts) + "), x -> x is not null)"


def _splices() -> str:
    """SQL for the consequences at the ends of exon e, the i-th of n. Each side of a junction is read as the genome has it."""

    def put(side: str, at: str) -> str:
        return f"overlay({side} placing a from cast({at} as int) for length(r))"

    def junction(intron: str, exon: str, minus: str, begin: bool) -> str:
        # In the genome: plus donor AG|GTNAG, plus acceptor AG|G; on the other strand both complemented and turned.
        last = lambda s, k: f"substring({s}, length({s}) - {k - 1}, {k})"
        first = lambda s, k: f"substring({s}, 1, {k})"
        lost = lambda old, new, f, k, bases: f"({f(old, k)} = '{bases}' and {f(new, k)} <> '{bases}')"
        i, j = intron.split("|")
        e, g = exon.split("|")
        if begin:  # the intron stands before the exon
            far = lambda s: f"substring({s}, length({s}) - 4, 2)"
            return (f"case when not minus then case when {lost(i, j, last, 2, 'AG')} then 'splice-acceptor-in2' when {lost(e, g, first, 1, 'G')} then 'splice-acceptor-ex1g' else 'splice' end "
                    f"when {lost(i, j, last, 2, 'AC')} then 'splice-donor-in2' when {far(i)} = 'CT' and {far(j)} <> 'CT' then 'splice-donor-in45ag' when {lost(e, g, first, 2, 'CT')} then 'splice-donor-ex2ag' else 'splice' end")  # fmt: skip
        far = lambda s: f"substring({s}, 4, 2)"
        return (f"case when not minus then case when {lost(i, j, first, 2, 'GT')} then 'splice-donor-in2' when {lost(e, g, last, 2, 'AG')} then 'splice-donor-ex2ag' when {far(i)} = 'AG' and {far(j)} <> 'AG' then 'splice-donor-in45ag' else 'splice' end "
                f"when {lost(i, j, first, 2, 'CT')} then 'splice-acceptor-in2' when {lost(e, g, last, 1, 'C')} then 'splice-acceptor-ex1g' else 'splice' end")  # fmt: skip

    i1, e1 = "substring(e.seq1, 1, cast(e.first - e.from1 as int))", "substring(e.seq1, cast(e.first - e.from1 + 1 as int))"
    e2, i2 = "substring(e.seq2, 1, cast(e.last - e.from2 + 1 as int))", "substring(e.seq2, cast(e.last - e.from2 + 2 as int))"
    d1, d2 = "(e.first - bp1)", "(e.last - bp1)"
    at1 = junction(f"{i1}|if({d1} > 0, {put(i1, f'length({i1}) - {d1} + 1')}, {i1})", f"{e1}|if({d1} > 0, {e1}, {put(e1, f'1 - {d1}')})", "minus", True)
    inner = f"({d2} >= 0 or ({d2} = -1 and length(a) > length(r)))"
    at2 = junction(f"{i2}|if({inner}, {i2}, {put(i2, f'-{d2}')})", f"{e2}|if({inner}, {put(e2, f'length({e2}) - greatest({d2}, 0)')}, {e2})", "minus", False)
    before = "aggregate(slice(exons, 1, i), 0L, (s, x) -> s + x.last - x.first + 1)"
    common = {"exon": "if(minus, n - i, i + 1)", "ofptv": f"if({before} % 3 <> (e.last - e.first + 1) % 3, 1, 0)", "nmd": "0"}
    deleted = f"(length(r) > length(a) and ((i > 0 and bp1 < e.first and bp2 >= e.first) or (i < n - 1 and bp1 <= e.last and bp2 > e.last)))"
    return _rows(
        (deleted, _row(type="'splice-deletion'", dist="0", exon="0", nmd="0", ofptv="0")),
        (f"not {deleted} and i > 0 and {d1} between {1 - SPLICE} and {SPLICE}", _row(type=at1, dist=f"if(minus, {d1}, -{d1})", **common)),
        (f"not {deleted} and i < n - 1 and {d2} between {-SPLICE} and {SPLICE - 1}", _row(type=at2, dist=f"-{d2}", **common)),
    )


def placed(met: DataFrame) -> DataFrame:
    """met (variant's chr, bp1, bp2, r, a; transcript's minus, exons, cds) with `found`: what isn't coding, and `hit`: the coding part that is changed, if any."""
    out = met.withColumn("ins", F.expr("if(r = '', 1, 0)")).withColumn("n", F.size("exons")).withColumn("m", F.size("cds"))
    out = out.withColumn("inside", F.expr("exists(exons, e -> bp1 <= e.last + ins and e.first <= bp2)"))
    out = out.withColumn("hit", F.expr("try_element_at(filter(cds, (c, i) -> bp1 <= c.last + if(i < m - 1, ins, 0) and c.first + if(i = 0, ins, 0) <= bp2), -1)"))
    out = out.withColumn("splices", F.expr(f"flatten(transform(exons, (e, i) -> {_splices()}))"))
    early, late = "bp1 < try_element_at(cds, 1).first + ins", "bp2 > try_element_at(cds, -1).last"
    others = _rows(
        (f"inside and m > 0 and if(minus, {late}, {early})", _row(type="'5-UTR'")), (f"inside and m > 0 and not if(minus, {late}, {early}) and if(minus, {early}, {late})", _row(type="'3-UTR'")),
        ("inside and m = 0", _row(type="'npcRNA'")), ("not inside", _row(type="'intronic'")))
    penult = "if(n > 1, aggregate(slice(exons, 1, n - 1), 0L, (s, x) -> s + x.last - x.first + 1), 0)"
    return out.withColumn("found", F.concat("splices", F.expr(others))).withColumn("penult", F.expr(penult)).select("*", *[F.expr(f"if(inside, hit, null).{x}").alias(f"hit_{x}") for x in ("first", "last", "offset")]).drop("hit")


def coding(hits: DataFrame) -> DataFrame:
    """hits (what `placed` gave, with cdna and frame) with `changes`: what the variant does to the protein."""
    out = hits.withColumn("z", F.expr("hit_offset + greatest(if(minus, hit_last - (bp1 + length(r) - 1), bp1 - hit_first), 0)"))
    low, high = "greatest(hit_first - bp1, 0)", "greatest(bp2 - hit_last - if(ins = 1 and bp1 = hit_last + 1, 1, 0), 0)"
    out = out.withColumn("lead", F.expr(f"if(minus, {high}, {low})")).withColumn("trail", F.expr(f"if(minus, {low}, {high})"))
    out = out.withColumn("put", F.when(F.col("minus"), reverse_complement(F.col("a"))).otherwise(F.col("a")))
    out = out.withColumn("put", F.expr("if(lead >= length(put), '', substring(put, cast(lead + 1 as int), cast(greatest(length(put) - lead - trail, 0) as int)))"))
    out = out.withColumn("cut", F.expr("greatest(length(r) - lead - trail, 0)")).withColumn("like", F.expr("length(r) = length(a)"))
    out = out.withColumn("changed", F.expr("concat(substring(cdna, 1, cast(z as int)), put, substring(cdna, cast(z + cut + 1 as int)))"))
    # Replaced bases change the codons that they lie in; other changes are read to the end, and so is a lost start.
    out = out.withColumn("k0", F.expr("if(like and length(put) = cut and z - frame >= 3, (z - frame) div 3, 0)"))
    out = out.withColumn("codons", F.expr("if(like and length(put) = cut and k0 > 0, (z + cut - 1 - frame) div 3 - k0 + 1, null)"))
    window = lambda c: F.expr(f"if(codons is null, substring({c}, cast(frame + 3 * k0 + 1 as int)), substring({c}, cast(frame + 3 * k0 + 1 as int), cast(3 * codons as int)))")
    out = out.withColumn("rc", codons(window("cdna"))).withColumn("vc", codons(window("changed")))
    out = out.withColumn("ra", F.transform("rc", amino)).withColumn("va", F.transform("vc", amino))
    out = out.withColumn("size", F.expr("cast(ceil((length(cdna) - frame) / 3) as bigint)"))
    out = out.withColumn("both", F.expr("""zip_with(arrays_zip(rc, ra), arrays_zip(vc, va), (x, y) -> named_struct('rc', coalesce(x.rc, '_'), 'ra', coalesce(x.ra, '_'), 'vc', coalesce(y.vc, '_'), 'va', coalesce(y.va, '_')))"""))
    out = out.withColumn("longest", F.expr("greatest(size, k0 + size(both))"))
    stop = "coalesce(try_element_at(filter(transform(both, (b, i) -> if(b.ra = '*' and b.va = '*', i, null)), x -> x is not null), 1), size(both))"
    out = out.withColumn("stop", F.expr(f"if(like, size(both), {stop})"))
    out = out.withColumn("diffs", F.expr("filter(transform(both, (b, i) -> if(b.ra <> b.va and i < stop, i, null)), d -> d is not null)"))
    out = out.withColumn("fs", F.expr("(length(changed) - length(cdna)) % 3 <> 0")).withColumn("d0", F.expr("try_element_at(diffs, 1)"))
    out = out.withColumn("d1", F.expr("try_element_at(filter(diffs, d -> element_at(both, d + 1).va = '*'), 1)"))
    of = lambda d, field: f"try_element_at(both, {d} + 1).{field}"
    letters = lambda d: {"codon": f"concat('c.', z + 1, {of(d, 'rc')}, '>', {of(d, 'vc')})", "cpos": "z + 1"}
    protein = lambda d, p: {"protein": f"concat('p.', {p}, {of(d, 'ra')}, '>', {of(d, 'va')})", "ppos": p}
    at = "(k0 + d + 1)"
    stops = f"{at} * 3 < penult - 50"
    each = "transform(diffs, d -> case " + " ".join(
        f"when {c} then {_row(type=t, pep=pep, newpep=new, **letters('d'), **protein('d', at), **more)}" for c, t, pep, new, more in (
            (f"{of('d', 'va')} <> '*' and {of('d', 'ra')} <> '*'", f"if({of('d', 'va')} = '?', 'exonic-unknown', 'missense')", "longest", "longest", {}),
            (f"{of('d', 'va')} = '*'", "'nonsense'", "size", at, {"ofptv": "1", "nmd": f"if({stops}, 1, 0)"}),
            ("true", "'read-through'", "size", "longest", {}))) + " end)"
    start = "try_element_at(filter(transform(va, (x, i) -> if(x = 'M' and i > 0, i + 1, null)), x -> x is not null), 1)"
    lost = _rows((f"d0 = 0 and k0 = 0 and {of('d0', 'ra')} = 'M'", _row(type="'start-lost'", fsx=f"coalesce({start}, -1)", pep="size", newpep=f"coalesce(size - {start} + 1, 0)", ofptv="0", nmd="0", **letters("d0"), **protein("d0", "1"))))
    run = "size(filter(diffs, d -> d <= {}))"
    ended = "(d1 is null and try_element_at(diffs, -1) = size(both) - 1)"
    place = "((z div 3) + 1)"
    kind = lambda what, letter: f"case when z % 3 <> 0 then 'out-of-frame-codon-{what}' when {of('d0', letter)} = '*' then 'stop-{what}' else 'codon-{what}' end"
    end = "try_element_at(diffs, -1)"
    shifted = "if(d1 is null, {}, {})"
    indel = _rows(
        (f"fs and d0 is not null and (d1 is not null or {ended})", _row(type="'frameshift'", cpos="z + 1", ppos="d0 + 1", pep="size", newpep=shifted.format("longest", "d1 + 1"), fsx=f"if(d1 is null, size(diffs), {run.format('d1')}) - 1",
              ofptv="1", nmd="if((d1 + 1) * 3 < penult - 50, 1, 0)")),
        (f"fs and {ended} and {of(end, 'ra')} = '*'", _row(type="'read-through'", pep="size", newpep="longest", ppos="size(both)", **letters(end),
              protein=f"concat('p.', size(both), '*>', {of(end, 'va')})")),
        ("not fs and d0 is not null and length(r) > length(a)", _row(type=kind("deletion", "ra"), cpos="z + 1", ppos=place, pep="size", newpep="size(va)")),
        ("not fs and d0 is not null and length(r) < length(a)", _row(type=kind("insertion", "va"), cpos="z + 1", ppos=place, pep="size", newpep="size(va)")),
        ("stop < size(both)", _row(type="'indel'", cpos="z + 1", ppos=place)))
    return out.withColumn("changes", F.expr(f"""case when cdna = changed then array({_row(type="'monomorphic'")}) when ra = va then array({_row(type="'silent'")})
        when like then concat({each}, {lost}) else {indel} end"""))


def annotate(variants: DataFrame, parts: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    """(var_id, alt, transcript, gene, class, FIELDS): a row for each consequence of each ALT in each transcript that it meets.

    variants (var_id, chr, bp1, ref, alt), parts as `transcripts` takes them, pieces as `sequences` does. Outside of all
    transcripts a variant is an intergenic-region. Of a deletion or insertion the codon and protein fields are null. Alleles are
    placed in reading direction on both strands. NMD is taken to follow where the new stop lies more than 50 bases
    before the last exon junction.
    """
    return _annotated(variants, *(kept(t, "transcripts") for t in transcripts(parts, pieces, width)))


def _annotated(variants: DataFrame, table: DataFrame, seqs: DataFrame) -> DataFrame:
    each = alleles(variants)
    bounds = table.select("transcript", "chr", "bp1", "bp2")
    pairs = overlaps(each, bounds).select(*[F.col(f"a_{c}").alias(c) for c in each.columns], F.col("b_transcript").alias("transcript"))
    met = pairs.join(table.drop("bp1", "bp2"), ["transcript", "chr"])
    at = kept(placed(met).drop("exons", "cds", "splices", "inside", "n", "m"), "placed")
    out = at.select("var_id", "alt", "transcript", "gene", F.inline_outer("found")).where("type is not null")
    hits = coding(at.where("hit_first is not null").drop("found").join(seqs, ["transcript", "chr"]))
    changes = hits.select("var_id", "alt", "transcript", "gene", F.inline_outer("changes")).where("type is not null")
    seen = each.select("var_id", "alt", F.lit(0).alias("met")).union(at.select("var_id", "alt", F.lit(1))).groupBy("var_id", "alt").agg(F.max("met").alias("met"))
    nowhere = F.lit(None).cast("string")
    alone = seen.where("met = 0").select("var_id", "alt", nowhere.alias("transcript"), nowhere.alias("gene"), F.inline(F.array(F.expr(_row(type="'intergenic-region'")))))
    names = F.create_map(*[F.lit(x) for pair in CLASS_OF.items() for x in pair])
    return out.union(changes).union(alone).select("var_id", "alt", "transcript", "gene", F.coalesce(F.try_element_at(names, F.col("type")), F.col("type")).alias("class"), *_NAMES).distinct()


def worst(consequences: DataFrame) -> DataFrame:
    """(var_id, func, gene, annot_full, n): a variant's worst class, the genes that it has it in, `mixed` where several classes count, and its consequences."""
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    ranked = consequences.withColumn("_r", F.when(rank > 0, rank))
    top = ranked.groupBy("var_id").agg(F.min("_r").alias("_r"), F.countDistinct(F.when(F.col("class").isin(MIXED), F.col("class"))).alias("_k"), F.count(F.lit(1)).alias("n"),
        F.collect_set(F.when(F.col("_r").isNotNull() & F.col("gene").isNotNull(), F.struct("_r", "gene"))).alias("_g"))
    genes = F.array_join(F.array_sort(F.transform(F.filter("_g", lambda x: x["_r"] == F.col("_r")), lambda x: x["gene"])), ",")
    func = F.when(F.col("_r").isNull(), "?").otherwise(F.try_element_at(F.array(*map(F.lit, CLASSES)), F.col("_r").cast("int")))
    return top.select("var_id", func.alias("func"), F.when(genes == "", ".").otherwise(genes).alias("gene"), F.when(F.col("_k") > 1, "mixed").otherwise(func).alias("annot_full"), "n")


def loc_annotate(study: Study) -> DataFrame:
    return annotate(study.variants, study.transcripts, study.reference, PIECE)


def annotated_variants(study: Study) -> DataFrame:
    """Each variant's worst consequence, its genes, and how many consequences it has."""
    return worst(loc_annotate(study))


def gs_view(study: Study) -> DataFrame:
    """(transcript, gene, codon_no, chr, low, high, exon, split, codon, aa, variants, refs, features): each coding codon in reading direction.

    variants: at the base that each starts at, `ALT..`, `.ALT.` or `..ALT` by its place in the codon, ALT alleles of cases and
    controls, and what the variant does in this transcript. refs: names of reference sites by group. features: protein features of
    the transcript or its gene that hold the codon's last base. exon counts coding parts; a split codon lies in two.
    """
    table, seqs = (kept(t, "transcripts") for t in transcripts(study.transcripts, study.reference, PIECE))
    part = table.join(seqs, ["transcript", "chr"]).select("transcript", "gene", "chr", "minus", "cdna", "frame", F.size("cds").alias("parts"), F.posexplode("cds").alias("k", "c"))
    base = part.select("transcript", "gene", "chr", "minus", "cdna", "frame", F.when(F.col("minus"), F.col("parts") - F.col("k")).otherwise(F.col("k") + 1).alias("exon"), "c.first", "c.last", "c.offset")
    base = base.withColumn("bp", F.explode(F.sequence("first", "last")))
    base = base.withColumn("i", F.col("offset") + F.when(F.col("minus"), F.col("last") - F.col("bp")).otherwise(F.col("bp") - F.col("first")) - F.col("frame")).where("i >= 0")
    base = base.select("transcript", "gene", "chr", "bp", "exon", "i", (F.expr("i div 3") + 1).alias("codon_no"), F.substring("cdna", (F.col("i") + F.col("frame") + 1).cast("int"), F.lit(1)).alias("base"))
    found = _annotated(study.variants, table, seqs).where("transcript is not null").groupBy("var_id", "transcript")
    what = found.agg(F.array_join(F.array_sort(F.collect_set(F.concat("type", F.coalesce(F.concat(F.lit("|"), "protein"), F.lit(""))))), ",").alias("what"))
    sites = base.select("transcript", "chr", "bp", "i").join(counted(study).select("var_id", "chr", F.col("bp1").alias("bp"), "alt", "a_ac", "u_ac"), ["chr", "bp"]).join(what, ["var_id", "transcript"], "left")
    place = F.expr("case i % 3 when 0 then concat(alt, '..') when 1 then concat('.', alt, '.') else concat('..', alt) end")
    label = F.concat(place, F.lit("|A/U="), F.col("a_ac").cast("string"), F.lit(":"), F.col("u_ac").cast("string"), F.lit("|"), F.coalesce("what", F.lit(".")))
    seen = sites.groupBy("transcript", "chr", "bp").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("var_id", label.alias("s")))), lambda x: x["s"]), " ").alias("seen"))
    refs = study.refs.groupBy("chr", F.col("bp1").alias("bp")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grp", "name"))), lambda x: F.concat(x["grp"], F.lit(":"), x["name"])), ",").alias("refs"))
    last = base.where("i % 3 = 2").select("transcript", "gene", "chr", F.col("bp").alias("bp1"), "codon_no")
    # A feature names its transcript or gene, so it meets their codons by name.
    p = study.proteins.select(F.col("transcript").alias("p_of"), F.col("chr").alias("p_chr"), F.col("bp1").alias("p1"), F.col("bp2").alias("p2"), F.col("source").alias("i_source"), F.col("feature").alias("i_feature"))
    named = last.withColumn("p_of", F.explode(F.array_distinct(F.array("transcript", "gene"))))
    held = named.join(p, "p_of").where((F.col("p_chr") == F.col("chr")) & F.col("bp1").between(F.col("p1"), F.col("p2")))
    features = held.groupBy("transcript", "codon_no").agg(F.array_join(F.array_sort(F.collect_set(F.concat("i_source", F.lit(":"), "i_feature"))), ",").alias("features"))
    rows = base.join(seen, ["transcript", "chr", "bp"], "left").join(refs, ["chr", "bp"], "left").groupBy("transcript", "gene", "codon_no", "chr")
    in_order = lambda c: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("i", F.col(c).alias("s")))), lambda x: x["s"].isNotNull()), lambda x: x["s"])
    text = lambda c: F.when(F.count(c) > 0, F.array_join(in_order(c), " "))
    codon = rows.agg(F.min("bp").alias("low"), F.max("bp").alias("high"), F.min("exon").alias("exon"), (F.max("exon") > F.min("exon")).alias("split"), F.array_join(in_order("base"), "").alias("codon"), text("seen").alias("variants"), text("refs").alias("refs"))
    return codon.join(features, ["transcript", "codon_no"], "left").withColumn("aa", amino(F.rpad("codon", 3, "-")))


def counts_annotated(study: Study) -> DataFrame:
    """Minor allele counts of cases and controls, with FUNC and GENE."""
    return counts(study).join(annotated_variants(study).select("var_id", "func", "gene"), "var_id", "left")
