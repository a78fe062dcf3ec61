"""Annotation against plain Python that writes each changed transcript out in full."""

import random

import pytest

from genoforge.operators import annotation as A
from genoforge.sources.projection import study

CODE = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"))
TURN = str.maketrans("ACGT", "TGCA")


def translated(seq):
    seq += "-" * (-len(seq) % 3)
    return ["x" if "-" in c else CODE.get(c, "?") for c in (seq[i : i + 3] for i in range(0, len(seq), 3))]


def trim(pos, ref, alt):
    while ref and alt and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    while len(ref) == len(alt) and ref and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    return pos, ref, alt


def splice(genome, t, pos, ref, alt):
    """Consequences at exon ends: sides of a junction in reading direction, before and after."""
    exons, minus = t["exons"], t["strand"] == "-"
    n, end = len(exons), pos + max(len(ref), 1) - 1
    for s, (e1, e2) in enumerate(exons):
        if len(ref) > len(alt) and ((s > 0 and pos < e1 <= end) or (s < n - 1 and pos <= e2 < end)):
            yield "splice-deletion", 0, 0, 0
            continue
        frame = int(sum(b - a + 1 for a, b in exons[:s]) % 3 != (e2 - e1 + 1) % 3)
        number = n - s if minus else s + 1
        for begin in (True, False):
            d = (e1 if begin else e2) - pos
            if (begin and s > 0 and -4 <= d <= 5) or (not begin and s < n - 1 and -5 <= d <= 4):
                if begin:
                    left, right, edge = genome[e1 - 30 : e1], genome[e1 : e1 + 30], e1
                    in_left = d > 0
                else:
                    left, right, edge = genome[e2 - 29 : e2 + 1], genome[e2 + 1 : e2 + 31], e2 + 1
                    in_left = d >= 0 or (d == -1 and len(alt) > len(ref))
                at = pos - (edge if not in_left else edge - 30)
                if not begin and d == -1 and in_left:
                    at = 29
                side = left if in_left else right
                new = side[:at] + alt + side[at + len(ref) :]
                sides = [(left, right), (new, right) if in_left else (left, new)]
                if minus:
                    sides = [(b[::-1].translate(TURN), a[::-1].translate(TURN)) for a, b in sides]
                (u, v), (u2, v2) = sides
                donor = begin == minus
                if donor:  # exon | intron
                    kind = ("splice-donor-in2" if v[:2] == "GT" != v2[:2] else "splice-donor-in45ag" if v[3:5] == "AG" != v2[3:5] else "splice-donor-ex2ag" if u[-2:] == "AG" != u2[-2:] else "splice")
                else:
                    kind = "splice-acceptor-in2" if u[-2:] == "AG" != u2[-2:] else "splice-acceptor-ex1g" if v[0] == "G" != v2[0] else "splice"
                yield kind, (d if minus else -d) if begin else -d, number, frame


def plain(genome, t, pos, ref, alt):
    """{(type, cpos, ppos, dist, exon, nmd, ofptv, pep, newpep, fsx)} of one trimmed allele in one transcript."""
    out, exons, cds, minus = set(), t["exons"], t["cds"], t["strand"] == "-"
    ins, end = not ref, pos + max(len(ref), 1) - 1
    row = lambda kind, **k: out.add((kind, *(k.get(x) for x in ("cpos", "ppos", "dist", "exon", "nmd", "ofptv", "pep", "newpep", "fsx"))))
    for kind, d, number, frame in splice(genome, t, pos, ref, alt):
        row(kind, dist=d, exon=number, nmd=0, ofptv=frame)
    inside = any(pos <= b + ins and a <= end for a, b in exons)
    if not inside:
        row("intronic")
        return out
    if not cds:
        row("npcRNA")
        return out
    early, late = pos < cds[0][0] + ins, end > cds[-1][1]
    if late if minus else early:
        row("5-UTR")
    elif early if minus else late:
        row("3-UTR")
    hit = [s for s, (a, b) in enumerate(cds) if pos <= b + (ins and s < len(cds) - 1) and a + (ins and s == 0) <= end]
    if not hit:
        return out
    places = [p for a, b in cds for p in range(a, b + 1)]
    part = set(range(cds[hit[-1]][0], cds[hit[-1]][1] + 1))
    bases, new = {p: genome[p] for p in places}, {p: genome[p] for p in places}
    if ins:
        if pos in part:
            new[pos] = alt + new[pos]
        else:
            new[pos - 1] += alt
        cpos = (sum(p >= pos for p in places) if minus else sum(p < pos for p in places)) + 1
    else:
        inner = [p for p in range(pos, end + 1) if p in part]
        # what stands outside of the part is left out; an allele of another length loses as much at that end
        lead = sum(p < min(part) for p in range(pos, end + 1))
        trail = sum(p > max(part) for p in range(pos, end + 1))
        a = "" if (trail if minus else lead) >= len(alt) else alt[lead : max(len(alt) - trail, lead)]
        for p in inner:
            new[p] = ""
        new[inner[-1] if minus else inner[0]] = a
        cpos = (sum(p > inner[-1] for p in places) if minus else sum(p < inner[0] for p in places)) + 1
    turn = (lambda s: s[::-1].translate(TURN)) if minus else (lambda s: s)
    before, after = turn("".join(bases[p] for p in places)), turn("".join(new[p] for p in places))
    if before == after:
        row("monomorphic")
        return out
    r, v = translated(before), translated(after)
    if r == v:
        row("silent")
        return out
    size, penult = len(r), sum(b - a + 1 for a, b in exons[:-1])
    longest = max(len(r), len(v))
    var = list(v)
    r, v = r + ["_"] * (longest - len(r)), v + ["_"] * (longest - len(v))
    known = {"cpos": cpos}
    nmd = lambda i: int((i + 1) * 3 < penult - 50)
    if len(ref) == len(alt):
        for i, (x, y) in enumerate(zip(r, v)):
            if x != y:
                if y == "*":
                    row("nonsense", ppos=i + 1, pep=size, newpep=i + 1, ofptv=1, nmd=nmd(i), **known)
                elif x == "*":
                    row("read-through", ppos=i + 1, pep=size, newpep=longest, **known)
                else:
                    row("exonic-unknown" if y == "?" else "missense", ppos=i + 1, pep=longest, newpep=longest, **known)
        if r[0] == "M" != v[0]:
            start = next((i + 1 for i in range(1, len(v)) if v[i] == "M"), -1)
            row("start-lost", ppos=1, fsx=start, pep=size, newpep=0 if start < 0 else size - start + 1, nmd=0, ofptv=0, **known)
        return out
    count, first, done = 0, None, False
    for i, (x, y) in enumerate(zip(r, v)):
        if x != y:
            count += 1
            first = i if first is None else first
            if len(before) % 3 != len(after) % 3:
                if y == "*" and not done:
                    done = True
                    row("frameshift", ppos=first + 1, fsx=count - 1, pep=size, newpep=i + 1, ofptv=1, nmd=nmd(i), **known)
                elif i == longest - 1 and not done:
                    row("frameshift", ppos=first + 1, fsx=count - 1, pep=size, newpep=longest, ofptv=1, nmd=0, **known)
                    if x == "*":
                        row("read-through", ppos=i + 1, pep=size, newpep=longest, **known)
            elif count == 1:
                kind, stop = ("deletion", x) if len(ref) > len(alt) else ("insertion", y)
                name = f"out-of-frame-codon-{kind}" if (cpos - 1) % 3 else f"stop-{kind}" if stop == "*" else f"codon-{kind}"
                row(name, ppos=(cpos - 1) // 3 + 1, pep=size, newpep=len(var), **known)
        if x == y == "*":
            row("indel", ppos=(cpos - 1) // 3 + 1, **known)
            break
    return out


def made(seed):
    """A genome of two chromosomes, transcripts of one to five exons on both strands, and variants of all kinds near them."""
    r = random.Random(seed)
    genome = {c: "".join(r.choice("ACGT") for _ in range(4000)) for c in (1, 2)}
    transcripts = []
    for k in range(14):
        c, at, exons = 1 + k % 2, 100 + 260 * k, []
        for _ in range(r.randint(1, 5)):
            exons.append((at, at + r.randint(8, 70)))
            at = exons[-1][1] + r.randint(15, 40)
        places = [p for a, b in exons for p in range(a, b + 1)]
        cut = sorted(r.sample(range(len(places)), 2))
        a, b = places[cut[0]], places[cut[1]]
        cds = [] if k == 5 else [(max(x, a), min(y, b)) for x, y in exons if max(x, a) <= min(y, b)]
        strand = "+-"[k // 2 % 2]
        if cds and k % 3:  # a start, and no stop too early
            g = list(genome[c])
            order = [p for x, y in cds for p in range(x, y + 1)]
            order = order if strand == "+" else order[::-1]
            for i in range(0, len(order) - 2, 3):
                codon = "ATG" if i == 0 else r.choice([x for x, y in CODE.items() if y != "*"])
                for p, base in zip(order[i : i + 3], codon):
                    g[p] = base if strand == "+" else base.translate(TURN)
            genome[c] = "".join(g)
        transcripts.append({"transcript": f"T{k}", "gene": f"G{k // 2}", "chr": c, "strand": strand, "exons": exons, "cds": cds})
    variants = []
    for k in range(1500):
        t = r.choice(transcripts)
        pos = r.randint(t["exons"][0][0] - 12, t["exons"][-1][1] + 12) if k % 4 else r.choice([p for e in t["exons"] for p in e]) + r.randint(-7, 7)
        ref = genome[t["chr"]][pos : pos + r.choice([1, 1, 1, 2, 3, 4, 6, 7])]
        word = lambda n: "".join(r.choice("ACGT") for _ in range(n))
        alt = [word(len(ref)), word(1), ref[0] + word(r.randint(1, 6)), ref[0], word(len(ref)) + "," + ref[0] + word(3), "N"][r.choice([0, 0, 0, 1, 2, 3, 4, 5])]
        variants.append((k, t["chr"], pos, ref, alt))
    return genome, transcripts, variants


def tables(spark, genome, transcripts, variants, width=64):
    parts = [(t["transcript"], t["gene"], kind, t["chr"], a, b, t["strand"], 0) for t in transcripts for kind, own in (("exon", t["exons"]), ("CDS", t["cds"])) for a, b in own]
    pieces = [(c, k, g[k * width : (k + 1) * width].lower() if k % 2 else g[k * width : (k + 1) * width]) for c, g in genome.items() for k in range(-(-len(g) // width))]
    return (spark.createDataFrame(variants, "var_id long, chr int, bp1 long, ref string, alt string"),
            spark.createDataFrame(parts, "transcript string, gene string, kind string, chr int, bp1 long, bp2 long, strand string, frame int"),
            spark.createDataFrame(pieces, "chr int, piece long, seq string"), width)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    genome, transcripts, variants = made(seed)
    got, want = {}, {}
    for x in A.annotate(*tables(spark, genome, transcripts, variants)).collect():
        got.setdefault((x.var_id, x.alt, x.transcript), set()).add((x.type, x.cpos, x.ppos, x.dist, x.exon, x.nmd, x.ofptv, x.pep, x.newpep, x.fsx))
    for k, c, pos, ref, alts in variants:
        for alt in set(alts.split(",")):
            p, r, a = trim(pos, ref, alt)
            met = [t for t in transcripts if t["chr"] == c and p <= t["exons"][-1][1] and t["exons"][0][0] <= p + max(len(r), 1) - 1]
            for t in met:
                if rows := plain(genome[c], t, p, r, a):
                    want[k, alt, t["transcript"]] = rows
            if not met:
                want[k, alt, None] = {("intergenic-region", *[None] * 9)}
    wrong = {k: (got.get(k), want.get(k), variants[k[0]]) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert not wrong, (len(wrong), len(want), list(wrong.items())[:3])
    kinds = {x[0] for rows in want.values() for x in rows}
    assert len(kinds) >= 20, kinds


def test_codons_and_summary(spark):
    genome = {1: "N" * 10 + "ATGGCCTGGTAA" + "N" * 30}
    transcripts = [{"transcript": "T", "gene": "G", "chr": 1, "strand": "+", "exons": [(10, 21)], "cds": [(10, 21)]}, {"transcript": "U", "gene": "H", "chr": 1, "strand": "+", "exons": [(10, 21)], "cds": []}]
    variants = [(1, 1, 14, "C", "T"), (2, 1, 18, "G", "A"), (3, 1, 30, "N", "A"), (4, 1, 15, "C", "T,A"), (5, 1, 10, "A", "A"), (6, 1, 10, "A", "C")]
    rows = A.annotate(*tables(spark, genome, transcripts, variants))
    own = {(x.var_id, x.type): (x.codon, x.protein) for x in rows.where("transcript = 'T'").collect()}
    assert own[1, "missense"] == ("c.5GCC>GTC", "p.2A>V") and own[2, "nonsense"] == ("c.9TGG>TGA", "p.3W>*") and own[4, "silent"] == (None, None) and (5, "monomorphic") in own
    worst = {x.var_id: (x.func, x.gene, x.annot_full) for x in A.worst(rows).collect()}
    assert worst[2] == ("nonsense", "G", "mixed") and worst[3] == ("intergenic", ".", "intergenic") and worst[4] == ("silent", "G", "mixed") and worst[6][0] == "start-lost"


def test_what_meets_transcripts_is_made_once(spark):
    """Neither the interval join nor what stands at exon ends is planned again by those who read consequences, and they read them once."""
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    plan, whole = (text(f(study(spark, "/root/testdata/sf0.001"))) for f in (A.annotated_variants, A.loc_annotate))
    assert "_a_bin" not in plan and "seq1" not in plan
    assert plan.count("Union") == whole.count("Union")
