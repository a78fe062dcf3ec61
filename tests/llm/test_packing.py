import zlib
from collections import defaultdict

import numpy as np

from genoforge.llm import packing

from . import cases


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    pieces = packing.packed(cases.documents(spark), packing.vocabulary()).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for i, t, *_ in cases.rows():
        if i is not None:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            at = 0
            for p in sorted(by[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
                at += p.length
            assert at == len(ids)
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == ends[p.sequence_id]
        ends[p.sequence_id] += p.length
    assert set(ends) == set(range(len(ends))) and all(ends[s] == packing.WINDOW for s in range(len(ends) - 1))
    assert packing.packed(cases.empty(spark), packing.vocabulary()).count() == 0


def put(q, start, n, totals, window, quantum, weights=None):
    """(offset in the item, length, sequence, offset there) of n tokens at start of a queue."""
    node = packing.Node(np.asarray(totals), np.asarray(totals if weights is None else weights))
    pieces = packing._joined(*packing.placed(node, *[np.array([x]) for x in (q, start, n)], window, quantum))
    return list(zip(*[x.tolist() for x in packing.windowed(*pieces, window)[1:]]))


def test_windows_hold_the_shares():
    totals = np.array([50_000, 30_000, 5_000, 300])
    by = np.zeros((int(-(-totals.sum() // 2048)), len(totals)))
    for q, n in enumerate(totals):
        for start in range(0, n, 700):
            for _, k, s, _ in put(q, start, min(700, n - start), totals, 2048, 64):
                by[s, q] += k
    assert (by[:-1].sum(1) == 2048).all() and by.sum() == totals.sum()
    assert (np.abs(by[:-1] - 2048 * totals / totals.sum()) <= 64 * len(totals) + 1).all()


def test_windows_hold_the_target_weights():
    """Two to one to one as long as all last; who runs out leaves the share to the others."""
    totals, weights = np.array([60_000, 8_000, 90_000]), np.array([2.0, 1.0, 1.0])
    by = np.zeros((int(-(-totals.sum() // 2048)), 3))
    for q, n in enumerate(totals):
        for _, k, s, _ in put(q, 0, n, totals, 2048, 64, weights):
            by[s, q] += k
    assert (by[:-1].sum(1) == 2048).all() and (by.sum(0) == totals).all()
    assert (np.abs(by[:14] - [1024, 512, 512]) <= 193).all()
    dry = 17  # 8,000 tokens at 512 a window last for 15.6 windows; then two to one, until 60,000 are gone
    assert by[dry:, 1].sum() == 0 and (np.abs(by[dry : dry + 10] - [2048 * 2 / 3, 0, 2048 / 3]) <= 193).all() and (by[-20:-1, 2] == 2048).all()


def whole_matrix(queue, start, n, totals, window, quantum):
    """Offsets of the n tokens at start of a queue, from all rounds at once."""
    upto = packing.Node(totals, totals).sent(np.arange(-(-int(totals.sum()) // window) + 1), window, quantum)
    at = upto.sum(1)[:-1] + np.diff(upto[:, :queue], axis=0).sum(1)
    r = np.searchsorted(upto[:, queue], np.arange(start, start + n), side="right") - 1
    return at[r] + np.arange(start, start + n) - upto[r, queue]


def spread(pieces, window):
    return np.concatenate([s * window + o + np.arange(k) for _, k, s, o in pieces])


def test_places_are_those_of_all_rounds(monkeypatch):
    r = np.random.default_rng(3)
    for turn in range(60):
        monkeypatch.setattr(packing, "BLOCK", 1 << r.integers(2, 12))
        totals = r.integers(1, 10 ** r.integers(1, 6, r.integers(1, 9)))
        for q in range(len(totals)):
            start = int(r.integers(0, totals[q]))
            n = int(r.integers(1, totals[q] - start + 1))
            assert (spread(put(q, start, n, totals, 128, 16), 128) == whole_matrix(q, start, n, totals, 128, 16)).all()


def test_rare_source_takes_little_memory_and_time():
    import time
    import tracemalloc

    totals = np.array([10**12 // 1023] * 1023 + [100])
    tracemalloc.start()
    began = time.time()
    got = put(1023, 0, 100, totals, 2048, 8)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k for _, k, _, _ in got) == 100 and peak < 50_000_000 and took < 1
    assert got[-1][2] - got[0][2] > 400_000_000  # over the whole corpus


def test_sources_beyond_the_queues_keep_their_shares():
    r = np.random.default_rng(5)
    for count, most in ((3, 4), (9, 4), (40, 4)):
        sizes = np.sort(r.integers(2_000, 9_000, count))[::-1].copy()
        queues, seen, shared = packing.Queues(sizes, sizes.astype(float), most), [], {}
        for rank, size in enumerate(sizes.tolist()):
            starts = np.arange(0, size, 700)
            item, o, k, s, off = queues.placed(np.full(len(starts), rank), starts, np.minimum(700, size - starts), 256, 16)
            order = np.lexsort((o, item))
            at = spread(list(zip(*[x[order].tolist() for x in (o, k, s, off)])), 256)
            assert (np.diff(at) > 0).all()
            seen.append(at)
            if rank >= most - 1:
                shared[rank] = at
        assert (np.sort(np.concatenate(seen)) == np.arange(sizes.sum())).all()
        if count > most:  # in each tenth of the corpus, each has about a tenth of its tokens
            for rank, at in shared.items():
                tenths = np.bincount(at * 10 // int(sizes.sum()), minlength=10) / sizes[rank]
                assert (np.abs(tenths - 0.1) < 0.06).all()


def test_more_sources_than_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    pieces = packing.packed(cases.documents(spark), packing.vocabulary(), 64, 8).collect()
    at = sorted((p.sequence_id * 64 + p.offset, p.length) for p in pieces)
    assert at[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(at, at[1:]))


def test_a_full_memory_keeps_what_is_frequent(monkeypatch):
    """Words that every text has are encoded once however often the memory fills, which stays bounded, and ids are the tokenizer's."""
    monkeypatch.setattr(packing, "CACHED", 200)
    words, encoded = packing.WordIds(packing.vocabulary()), defaultdict(int)
    learn = words.learn

    def counted(pieces):
        for p in pieces:
            encoded[p] += 1
        return learn(pieces)

    words.learn = counted
    often = ["alpha", "it's", "naïve", "(well)", "x2"]
    for k in range(100):
        text = " ".join(often + [f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(9)])
        assert words.of(text) == words.ids(text).tobytes()
        assert max(map(len, (words.words, words.older_words, words.pieces, words.older_pieces))) <= 200
    assert [encoded[p] for p in ("alpha", "naïve", "well", "(", "'s")] == [1] * 5


def test_pieces_of_all_plain_characters():
    """Any two plain characters, alone and within words, have the tokenizer's ids, also when many texts are taken together."""
    plain = [chr(c) for c in range(0x180) if packing._PLAIN.fullmatch(chr(c))]
    texts = ["".join(f"{a}{b} x{a}{b}y{a}'{b} " for b in plain) for a in plain] + ["", " ", "<|endoftext|>", "\u0130\u3042 x"]
    words = packing.WordIds(packing.vocabulary())
    assert words.each(texts) == [words.ids(t).tobytes() for t in texts]


def test_a_piece_is_looked_up_once_for_many_texts(monkeypatch):
    """New pieces of texts that are taken together are encoded in one go, and again in none."""
    words, calls = packing.WordIds(packing.vocabulary()), []
    learn = words.learn
    words.learn = lambda pieces: calls.append(sorted(pieces)) or learn(pieces)
    texts = [f"Same words, it's number{k % 3}\n" for k in range(50)]
    assert words.each(texts) == [words.ids(t).tobytes() for t in texts] == words.each(texts)
    assert calls == [sorted(["same", "words", ",", "it", "'s", "number", "0", "1", "2"])]
    monkeypatch.setattr(packing, "TOGETHER", 40)
    assert words.each(texts) == [words.of(t) for t in texts] and len(calls) == 1
