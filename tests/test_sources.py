import gzip

import numpy as np

from genoforge.sources import readers as R
from genoforge.sources import writers as W


def test_vcf_round_trip(spark, tmp_path):
    text = "\n".join(["##fileformat=VCFv4.2", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s1 s2 s3".split()),
        "\t".join("1 100 rs1 A G 50 PASS DP=10;DB;DP=11;DP=10 GT:DP 0/1:5 1|1:6 ./.:.".split()), "\t".join("chrX 200 . AT A . q10 . GT 1 0/2 0/0".split())])
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(gzip.compress(text.encode()))
    variants, calls, samples = R.vcf(spark, str(path))
    v = {r.bp1: r for r in variants.collect()}
    assert samples == ["s1", "s2", "s3"] and v[100].info == {"DP": "10", "DB": None} and (v[200].chr, v[200].bp2, v[200].qual) == (23, 201, None)
    ids = {r.var_id: b for b, r in v.items()}
    c = {(ids[r.var_id], r.indiv_id): r for r in calls.collect()}
    assert [c[100, s].ac for s in samples] == [1, 2, None] and c[100, "s2"].phased and c[100, "s1"].gmeta == {"DP": "5"}
    assert c[200, "s1"].ploidy == 1 and c[200, "s1"].ac == 1 and c[200, "s2"].is_null  # allele 2 doesn't exist
    out = str(tmp_path / "out")
    W.write_vcf(variants, calls.select("var_id", "indiv_id", "ac").where("ac is null or ac > 0"), samples, out)
    lines = [r.value for r in spark.read.option("recursiveFileLookup", True).text(out).collect()]
    assert any(x.startswith("1\t100\trs1\tA\tG\t50.0\tPASS\t.\tGT\t0/1\t1/1\t./.") for x in lines)
    assert R.vcf_header(spark, str(path))[1].first().asDict() == {"kind": "INFO", "id": "DP", "number": "1", "type": "Integer", "description": "Depth"}


def test_plink(spark, tmp_path):
    g = np.array([[2, 1, 0, -1, 0], [0, 0, 1, 2, -1]])
    code = np.array([3, 2, 0, 1])  # of 0, 1, 2 and missing (-1)
    raw = b"\x6c\x1b\x01"
    for row in g:
        two = np.concatenate([code[row], np.zeros(3, int)])
        raw += bytes(int(sum(two[4 * k + j] << 2 * j for j in range(4))) for k in range(2))
    (tmp_path / "x.bed").write_bytes(raw)
    (tmp_path / "x.bim").write_text("1 rs1 0 100 G A\n2 rs2 0 200 T C\n")
    (tmp_path / "x.fam").write_text("".join(f"f p{k} 0 0 1 2\n" for k in range(5)))
    variants, geno, people = R.plink(spark, str(tmp_path / "x"))
    got = {(r.var_id, r.indiv_id): r.ac for r in geno.collect()}
    want = {(v, f"p{p}"): (None if g[v, p] < 0 else int(g[v, p])) for v in range(2) for p in range(5) if g[v, p] != 0}
    assert got == want and people.count() == 5 and [r.name for r in variants.orderBy("var_id").collect()] == ["rs1", "rs2"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "p.phe").write_text('##aff,Integer,0,"d"\n##bmi,Float,-9,"b"\n#ID aff bmi\na 2 20.5\nb 0 -9\nc 1\n')
    got = {(r.indiv_id, r.pheno): r.value for r in R.phenotypes(spark, str(tmp_path / "p.phe")).collect()}
    assert got == {("a", "aff"): "2", ("a", "bmi"): "20.5", ("b", "aff"): None, ("b", "bmi"): None}
    people = spark.createDataFrame([("a",), ("b",), ("z",)], "indiv_id string")
    made = {r.indiv_id: r.aff for r in R.make_phenotype(people, R.phenotypes(spark, str(tmp_path / "p.phe")), "aff", ["2"]).collect()}
    assert made == {"a": 2, "b": 1, "z": 1}
    (tmp_path / "x.ped").write_text("a f 1 . 0 1\nb f 2 a c 2\n")
    assert [(r.pat, r.mat) for r in R.pedigree(spark, str(tmp_path / "x.ped")).orderBy("indiv_id").collect()] == [(None, None), ("a", "c")]
    gtf = "\n".join(f'chr1\ts\t{f}\t{a}\t{b}\t.\t+\t0\tgene_id "G"; transcript_id "T";' for f, a, b in (("exon", 100, 199), ("CDS", 150, 199), ("exon", 300, 349), ("CDS", 300, 309)))
    (tmp_path / "x.gtf").write_text(gtf)
    loci, parts = R.gtf(spark, str(tmp_path / "x.gtf"))
    r = loci.first()
    assert (r.name, r.altname, r.bp1, r.bp2, r.exons) == ("T", "G", 100, 349, 2) and R.gtf_check(parts).count() == 0
    feature = spark.createDataFrame([("T", "dom", 16, 18)], "transcript string, feature string, begin int, end int")
    got = sorted((r.bp1, r.bp2) for r in R.protein_on_genome(feature, parts.where("feature = 'CDS'")).collect())
    assert got == [(195, 199), (300, 303)]
    (tmp_path / "x.fa").write_text(">chr1 first\nACGT\nACG\n>2\nTTT\n")
    chunks = R.fasta(spark, str(tmp_path / "x.fa"), 4)
    assert sorted((r.chr, r.bp1, r.bp2, r.seq) for r in chunks.collect()) == [(1, 1, 4, "ACGT"), (1, 5, 7, "ACG"), (2, 1, 3, "TTT")]
    assert R.sequence(chunks, spark.createDataFrame([(1, 3, 6)], "chr int, bp1 long, bp2 long"), 4).first().seq == "GTAC"
    (tmp_path / "r.txt").write_text("#position\tname\nchr3:10..20\tx\nchrX:7\ty\n")
    assert sorted((r.chr, r.bp1, r.bp2) for r in R.regions(spark, str(tmp_path / "r.txt")).collect()) == [(3, 10, 20), (23, 7, 7)]
    (tmp_path / "a.txt").write_text("#sym\tid\nA\t1\n")
    assert R.aliases(spark, str(tmp_path / "a.txt")).count() == 2
    (tmp_path / "v.txt").write_text("#CHR\tPOS\tID\tAF\n1\t5\trs9\t0.2\n")
    assert R.reference_variants(spark, str(tmp_path / "v.txt"), "g").first().meta == {"AF": "0.2"}
    (tmp_path / "n.txt").write_text("a b 0.5\nc d bad extra\n")
    assert R.network(spark, str(tmp_path / "n.txt")).count() == 2
    (tmp_path / "d.txt").write_text("rs1 0.1 0.9 1.02 0 0.7 0.3\n")
    got = {r.indiv_id: (round(r.dosage, 3), r.ac) for r in R.dosages(spark, str(tmp_path / "d.txt"), ["a", "b"], "prob3").collect()}
    assert got == {"a": (2.94, 2), "b": (1.3, None)}


def test_writers(spark, tmp_path):
    calls = spark.createDataFrame([(1, "a", {"PL": "0,10,20"})], "var_id long, indiv_id string, gmeta map<string,string>")
    assert W.likelihood_lines(calls, ["a", "b"]).first().line == "1.000000 0.100000 0.010000 1 1 1"
    phased = spark.createDataFrame([(1, "a", "0|1"), (2, "a", "1|1")], "var_id long, indiv_id string, gt string")
    assert W.haplotypes(phased, spark.createDataFrame([(1, 1), (2, 2)], "var_id long, place int")).first()[1:] == ("01", "11")
    v = spark.createDataFrame([(1, 2, 50, "rs", "A", "G")], "var_id long, chr int, bp1 long, name string, ref string, alt string")
    W.write_tped(v, spark.createDataFrame([(1, "b", 1)], "var_id long, indiv_id string, ac int"), ["a", "b"], str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "2 rs 0 50 A A A G"
    long = spark.createDataFrame([("a", "k", 1), ("a", "m", 2)], "id string, key string, value int")
    W.write_table(long, str(tmp_path / "w"), ("key", "value", ["k", "m"]))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "w")).first().asDict() == {"id": "a", "k": "1", "m": "2"}
