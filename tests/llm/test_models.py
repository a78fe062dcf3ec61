import zlib

import numpy as np
import pytest

from genoforge.llm import html_extract, language, licenses, media, quality
from genoforge.llm.common import table
from genoforge.llm.html_pages import Pages

from . import cases

SF = "/root/testdata/sf0.001"


def test_quality_held_out(spark):
    got = quality.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels")).join(table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    assert len(got) > 10 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_quality_edges(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(90)] + [(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(docs, labels).count() == len(cases.rows())
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, none).count() == len(cases.rows()) and quality.accepted(docs, labels).columns == docs.columns
    assert quality.quality_scores(cases.empty(spark), labels).count() == 0


def test_scores_against_numpy(spark):
    """Log densities of both classes by plain inverses and determinants of the shrunk covariances."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    known = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    learned = {i: q for i, q in known.items() if q in (0, 1) and i in texts and zlib.crc32(str(i).encode()) % 3 != 1}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    every = np.stack([x[i] for i in learned])
    groups = {c: np.stack([x[i] for i, q in learned.items() if q == c]) for c in (0, 1)}
    covs = {c: np.cov(g.T, bias=True) for c, g in groups.items()}
    pooled = sum(len(g) / len(every) * covs[c] for c, g in groups.items())
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))

    def density(v, c):
        shrunk = ((1 - quality.POOL - quality.RIDGE) * covs[c] + quality.POOL * pooled) / np.outer(scale, scale) + quality.RIDGE * np.eye(len(scale))
        z = (v - groups[c].mean(0)) / scale
        return np.log(len(groups[c]) / len(every)) - 0.5 * np.linalg.slogdet(shrunk)[1] - 0.5 * z @ np.linalg.inv(shrunk) @ z

    for r in quality.quality_scores(docs, labels).collect():
        gap = np.clip(density(x[r.doc_id], 1) - density(x[r.doc_id], 0), -500, 500)
        assert r.score == pytest.approx(1 / (1 + np.exp(-gap)), abs=1e-6)


def test_scores_are_density_differences():
    r = np.random.default_rng(1)
    x0, x1 = r.normal(0, 1, (400, 3)), r.normal(1, 2, (500, 3))
    model = quality.Discriminant({c: (len(x), x.sum(0), x.T @ x) for c, x in ((0, x0), (1, x1))})
    assert (model.score(x0) < 0.5).mean() > 0.7 and (model.score(x1) > 0.5).mean() > 0.7


def test_language_held_out(spark):
    docs = table(spark, SF, "documents")
    got = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and np.mean([r.lang_pred == r.lang for r in got]) > 0.9


def test_language_edges(spark):
    got = {r.doc_id: r for r in language.languages(cases.documents(spark)).where("doc_id is not null").collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[0].score == 0 and got[3].lang_pred in ("en", "fr")
    assert language.languages(cases.empty(spark)).count() == 0
    assert {r.lang_pred for r in language.languages(cases.documents(spark).withColumn("lang", cases_null())).collect()} == {"und"}


def cases_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_masks_hold_what_was_added():
    filters = language.BitSlicedFilters([f"l{k:02}" for k in range(70)])
    h = np.unique(language.grams("some words of a language and then a few more"))
    filters.add("l03", h)
    filters.add("l68", h[:10])
    e = filters.evidence(h, filters.false_rates())
    assert e[3] == pytest.approx(len(h), abs=1) and 9 <= e[68] <= 12 and e[5] == 0


def test_language_against_plain_sets(spark):
    """Every language that has an n-gram is found, and popcounts are those of plain sets but for the false positives."""
    docs = table(spark, SF, "documents")
    rows = docs.selectExpr("doc_id", "text", "lang").collect()
    seen = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            seen.setdefault(r.lang, set()).update(language.grams(r.text).tolist())  # as small a table has no n-gram that is too rare
    filters = language.trained(docs)
    rates = filters.false_rates()
    assert filters.languages == sorted(seen) and (rates < 0.01).all()
    right = 0
    for r in rows:
        h = language.grams(r.text)
        if not len(h):
            continue
        exact = np.array([sum(x in seen[lang] for x in h.tolist()) for lang in filters.languages], float)
        found = filters.masks(h)[0]
        for k, lang in enumerate(filters.languages):
            own = np.array([x in seen[lang] for x in h.tolist()])
            assert (found[own] >> np.uint64(k) & np.uint64(1)).all()
        e = filters.evidence(h, rates)
        assert np.abs(e - exact).max() <= 5 + 0.02 * len(h)
        right += e.argmax() == exact.argmax()
    assert right >= 0.99 * len(rows)


def test_license_notices(spark):
    lines = {1: "Hello there.\nReleased under the MIT License.\nmore", 2: "Licensed under CC BY-NC 4.0.", 3: "the license of the version under the public work", 4: None, 5: "",
             6: "(c) 2020 Someone. Licensed under the Apache License, Version 2.0.", 7: "All rights reserved.", 8: "This work is licensed under the GNU General Public License, version 3."}
    docs = spark.createDataFrame([(k, t, "x") for k, t in lines.items()], "doc_id long, text string, gram string")
    got = {(r.doc_id, r.paragraph, r.family) for r in licenses.notices(docs).collect()}
    assert got == {(1, 1, "mit"), (2, 0, "cc-by-nc"), (6, 0, "apache-2.0"), (7, 0, "proprietary"), (8, 0, "gpl-3.0")}
    assert licenses.notices(cases.empty(spark)).count() == 0


def test_license_notices_wrapped_and_several(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"
    share_alike = "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License."
    filler = "some words between the notices of a long line " * 60
    lines = {1: "MIT\n\n" + mit, 2: bsd, 3: "# x\n" + gpl, 4: share_alike, 5: "Released under the MIT License. " + filler + "Licensed under CC BY 4.0. " + filler,
             6: "Released under the BSD 3-Clause License. Released under the MIT License.", 7: "Released under the MIT License.\nReleased under the MIT License.", 8: mit + "\n\n" + bsd, 9: filler}
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.notices(spark.createDataFrame(list(lines.items()), "doc_id long, text string")).collect())
    assert got == [(1, 2, "mit"), (2, 0, "bsd"), (3, 1, "gpl-3.0"), (4, 0, "cc-by-sa"), (5, 0, "cc-by"), (5, 0, "mit"), (6, 0, "bsd"), (6, 0, "mit"), (7, 0, "mit"), (7, 1, "mit"), (8, 0, "mit"), (8, 3, "bsd")]


def test_html_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Menu</a></li></ul></nav><article><h1>A &amp; b</h1><p>First   <b>bold</b> text,\nhere.<p>Second one, with more words to read.<div class=ad>Buy now</div></article><footer>&copy; x</footer>"
    pages = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (None, "u", "<p", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extracted(pages).collect()}
    assert got[1].text == "A & b First bold text, here. Second one, with more words to read." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[None].text == ""


def test_html_end_tag_of_an_element_with_many_unclosed_ones():
    words = "The river rose for three days and the town moved its market to the hill. " * 8
    page = "<html><body><article><h1>River</h1>" + "<div>" * 400 + f"<p>{words}</p></article><footer class='footer'><p>Imprint and contact</p></footer></body></html>"
    tree = html_extract.Tree(page)
    footer = next(n for n in tree.nodes if n.tag == "footer")
    assert footer.parent.tag == "body" and footer.depth == 3
    text = html_extract.main_texts([page], html_extract.classifier())[0]
    assert "three days" in text and "Imprint" not in text
    stray = html_extract.Tree("<div>" + "</span></p></section>" * 5000 + "<p>a</p></div><p>b</p>")
    assert [n.parent.tag for n in stray.nodes if n.tag == "p"] == ["div", "#root"]


def test_html_on_unseen_layouts():
    model, right = html_extract.classifier(), 0
    for seed in range(20_000, 20_060):
        tree = html_extract.Tree(Pages(seed).page())
        want = " ".join(html_extract.blocks(tree, {n: html_extract.IN if html_extract._true(n) else html_extract.BEFORE for n in tree.nodes}))
        right += html_extract.main_texts([Pages(seed).page()], model)[0] == want
    assert right >= 54


def picture(r, side=14, cell=10):
    return np.kron(r.integers(0, 255, (side, side)), np.ones((cell, cell)))


def png(pixels, kind):
    """A PNG of one filter kind for all lines."""
    h, w, c = pixels.shape
    lines, above = [], np.zeros((w, c), int)
    for line in pixels.astype(int):
        left, corner = np.vstack([np.zeros((1, c), int), line[:-1]]), np.vstack([np.zeros((1, c), int), above[:-1]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, body: len(body).to_bytes(4, "big") + k + body + zlib.crc32(k + body).to_bytes(4, "big")
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_round_trip(kind):
    r = np.random.default_rng(kind)
    for c in (1, 2, 3, 4):
        pixels = r.integers(0, 256, (9, 7, c)).astype(np.uint8)
        assert (media.decoded(png(pixels, kind)) == media._grey(pixels).astype(np.float32)).all()
    assert media.decoded(png(pixels, kind)[:60]) is None and media.decoded(b"P5\n9 9\n255\n") is None
    assert media.decoded(b"P6 # x\n2 1 255\n" + bytes(6)).shape == (1, 2)


def test_media_copies(spark):
    r = np.random.default_rng(4)
    rows = []
    for k in range(12):
        a = picture(r)
        rows += [(100 * k, media.encoded(a)), (100 * k + 1, media.encoded(a[15:125, 10:130])), (100 * k + 2, media.encoded(np.clip(a * 0.9 + 9, 0, 255))), (100 * k + 3, png(np.rot90(a)[..., None], 2)), (100 * k + 4, media.encoded(a))]
    rows += [(5001, None), (5002, b"no"), (None, None), (5003, media.encoded(np.zeros((60, 60)))), (5100, None)]
    rows = [(i, x, "q", "d", 3, 4.0) for i, x in rows]
    schema = "media_id long, image binary, q string, digest string, d0 int, votes double"
    got = {(x.query_id, x.match_id): x for x in media.copies(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(100 * k, 100 * k + j) for k in range(12) for j in range(4)} | {(5100, 5001)}
    assert got[0, 0].copies == 2 and got[0, 0].votes is None
    assert media.copies(spark.createDataFrame([], schema)).count() == 0


def test_media_recall_against_all_pairs(spark):
    """Noisy, rescaled and strongly cropped copies of large pictures, and what a comparison of all pairs of images finds."""
    r = np.random.default_rng(8)
    rows, kinds = [], {}
    for k in range(5):
        a = picture(r, 20, 9)
        edits = {
            "noise": np.clip(a + r.normal(0, 6, a.shape), 0, 255), "crop": a[70:160, 40:130], "darker": a * 0.7,
            "half": media._scaled(a.astype(np.float32), 0.5), "smaller": media._scaled(a.astype(np.float32), 0.7), "turned": np.rot90(a, 2), "caption": np.vstack([a, np.full((40, a.shape[1]), 255)]),
        }
        rows.append((100 * k, media.encoded(a)))
        for j, (kind, b) in enumerate(edits.items(), 1):
            kinds[100 * k, 100 * k + j] = kind
            rows.append((100 * k + j, media.encoded(np.rint(b))))
    got = {(x.query_id, x.match_id) for x in media.copies(spark.createDataFrame(rows, "media_id long, image binary")).where("votes is not null").collect()}
    known = {i: media.descriptors(media.decoded(x)) for i, x in rows}
    want = set()
    for q in range(0, 500, 100):
        for m, (places, bits) in known.items():
            i, j = np.nonzero(np.bitwise_count(known[q][1][:, None] ^ bits[None]).sum(2) <= media.MOST_BITS_APART)
            if m != q and media.consensus(known[q][0], places, np.stack([i, j], 1)):
                want.add((q, m))
    assert len(got & want) >= 0.9 * len(want) and got <= want
    found = {kind: np.mean([p in got for p, x in kinds.items() if x == kind]) for kind in set(kinds.values())}
    print(found)
    assert got <= set(kinds) and min(v for v in found.values()) >= 0.9


def test_media_recall_by_distance(spark):
    """Descriptors that differ in so many bits are found: all up to 15, at least nine in ten up to MOST_BITS_APART."""
    r = np.random.default_rng(3)
    asked = r.integers(-(2**63), 2**63 - 1, (200, 4))
    rows = []
    for far in range(media.MOST_BITS_APART + 3):
        for q in asked.tolist():
            bits = np.unpackbits(np.array(q, ">i8").view(np.uint8))
            bits[r.choice(256, far, replace=False)] ^= 1
            rows.append((*np.packbits(bits).view(">i8").tolist(), far))
    names = "d0 long, d1 long, d2 long, d3 long"
    known = spark.createDataFrame([(*x[:4], x[4]) for x in rows], names + ", held int")
    found = media.alike(spark.createDataFrame(asked.tolist(), names), known).groupBy("held").count().collect()
    share = {x.held: x["count"] / 200 for x in found}
    print(share)
    assert all(share[k] == 1 for k in range(16)) and all(share[k] >= 0.9 for k in range(media.MOST_BITS_APART + 1)) and max(share) == media.MOST_BITS_APART


def test_near_descriptors_meet_once(spark):
    """Descriptors that agree in all words or in some are one pair, however many words they meet in."""
    r = np.random.default_rng(6)
    asked = r.integers(-(2**63), 2**63 - 1, (50, 4)).tolist()
    known = [(*q[:3], q[3] ^ (1 << k), k) for q in asked for k in (0, 40)] + [(*q, 99) for q in asked]
    names = "d0 long, d1 long, d2 long, d3 long"
    found = media.alike(spark.createDataFrame([(*q, i) for i, q in enumerate(asked)], names + ", q int"), spark.createDataFrame(known, names + ", held int"))
    assert sorted((x.q, x.held) for x in found.collect()) == sorted((q, k) for q in range(50) for k in (0, 40, 99))


def test_media_groups_are_those_of_all_links(spark, monkeypatch):
    """A row for each image, with the components of every link between a query and an image, also where queries ask in several turns."""
    monkeypatch.setattr(media, "FEWEST_ASKING", 2)
    monkeypatch.setattr(media, "TURN_BY", 3)
    r = np.random.default_rng(12)
    rows = []
    for k in range(3):  # ten queries of a picture, with edits that are near them and near each other
        a = picture(r)
        edits = [np.rint(np.clip(a * r.uniform(0.8, 1.1) + r.normal(0, 4, a.shape), 0, 255)) for _ in range(20)] + [a[20:, :110], a, a]
        rows += [(1000 * k + (100 * j if j < 10 else j), media.encoded(b)) for j, b in enumerate(edits)]
    rows += [(9001, media.encoded(picture(r))), (9002, None), (9003, b"no"), (9100, None), (None, None), (9001, b"other")]
    table = spark.createDataFrame(rows, "media_id long, image binary")
    got = media.grouped(table).collect()
    assert len(got) == len(rows) - 1
    top = {i: i for i, _ in rows if i is not None} | {9100: 9002}
    moved = True
    links = [(x.query_id, x.match_id) for x in media.copies(table).collect()] + [(x.media_id, x.class_id) for x in got]
    while moved:
        moved = False
        for a, b in links:
            least = min(top[a], top[b])
            moved |= (top[a], top[b]) != (least, least)
            top[a] = top[b] = least
    assert {(x.media_id, x.component_id) for x in got} == {(i, t) for i, t in top.items()}
    assert {x.component_id for x in got if x.media_id < 3000} == {0, 1000, 2000} and {x.copies for x in got if x.media_id == 21} == {2}
    assert media.grouped(table.limit(0)).count() == 0
