import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import chat, context_tree, decontaminate, license_scan, packing, quality, toxicity, warc
from tidemark.llm.tokenize import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer():
    rng = random.Random(4)
    letters = "abz ABZ019'-_!? \t\né ÉßŒ中Σİ́½²\x85\xa0\x1c<|>"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)]
    texts += ["it's WE'LL !'s 'tis", "a <|endoftext|> b", "", "aaaa'aaa", "x" * 5000, "don't'd 've're"]
    plain = Tokenizer.from_file(PATH)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in WordIds.of(PATH).encode([t.encode() for t in texts])] == want


def test_packing_is_whole_and_tight(docs_of, words):
    rng = random.Random(2)
    texts = [None, "", *(words(rng.choice([3, 40, 400, 1500])) for _ in range(40)), words(3000)]
    rows = list(enumerate(texts)) + [(1, "")]
    got = packing.pack(docs_of(rows), PATH, size=512, per_partition=20).collect()
    plain = Tokenizer.from_file(PATH)
    pieces = {}
    for k, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for p in range(0, len(ids), 512):
            key = (k, p // 512, p, len(ids[p : p + 512]), zlib.crc32(ids[p : p + 512].tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 512
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    assert len(bins) <= 1.1 * packing.lower_bound(np.array([r.length for r in got]), 512)
    assert packing.pack(docs_of([]), PATH).count() == 0


def test_sequences_hold_the_ids(docs_of, words):
    texts = [words(30), words(80), "", words(300)]
    rows = packing.sequences(docs_of(texts), PATH, size=128).collect()
    plain = Tokenizer.from_file(PATH)
    want = sorted(t for x in texts for t in [*plain.encode(x, add_special_tokens=False).ids, 0])
    assert sorted(t for r in rows for t in r.ids) == want and all(len(r.ids) <= 128 for r in rows)


def test_bounds_never_exceed_a_packing():
    rng = np.random.default_rng(0)
    for top in (10, 60, 100):
        for _ in range(20):
            x = rng.integers(1, top + 1, 60)
            where, offset, filled = packing.best_fit(x, 100)
            assert packing.lower_bound(x, 100) <= len(filled) and (filled <= 100).all() and filled.sum() == x.sum()
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def held(doc, item, percent=80):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    a, b = shingles(item), shingles(doc)
    return (len(a), len(a & b)) if a and 100 * len(a & b) >= percent * len(a) else None


@pytest.mark.parametrize("rows", [500_000, 0])
def test_contained_items_as_brute_force(spark, docs_of, words, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(8)
    items = [words(n) for n in (6, 8, 9, 17, 40, 60)] + ["two words", None, "", words(12)]
    texts = [None, "", "Two\tWORDS", "two words more"]
    for item in items[:6]:
        w = item.split()
        for share in (0.0, 0.02, 0.04, 0.08):
            texts.append(" ".join([words(50), *(x if rng.random() >= share else "zz" for x in w), words(30)]).upper())
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contained(docs_of(texts), table).collect()
    want = {(k, j): h for k, t in enumerate(texts) for j, i in enumerate(items) if (h := held(t, i))}
    assert {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in got} == want and len(got) == len(want)
    kept = decontaminate.clean(docs_of([*enumerate(texts), (None, None)]), table)
    assert {r.doc_id for r in kept.collect()} == {None, *range(len(texts))} - {k for k, _ in want}
    assert decontaminate.contained(docs_of([]), table).count() == 0
    assert decontaminate.contained(docs_of(texts), table.limit(0)).count() == 0


def test_quality_counts_as_brute_force(docs_of, words):
    phrase = words(7)
    texts = [None, "", " \n\t", "one", f"{phrase} {words(20)} {phrase}", "a\nb\na\n\n\na\n c", "spam " * 300, words(3000), words(15) + " ###$%&|<>*", "é ü x\x0by", phrase + "\n" + phrase, "\n".join([words(12)] * 40)]
    rng = random.Random(0)
    texts.append("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=9000)).replace("A", " "))
    got = {r.doc_id: r for r in quality.judged(docs_of(texts)).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        dup = sum(x in lines[:i] for i, x in enumerate(lines))
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat)), k
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and (not r.base_failed or not r.kept)
        if t:
            assert abs(r.ratio - len(zstandard.ZstdCompressor(level=3).compress(t.encode())) / len(t.encode())) < 1e-9
    assert got[7].kept and not got[6].kept and not got[11].kept and not got[12].kept
    assert {r.doc_id for r in quality.passing(docs_of(texts)).collect()} == {k for k, r in got.items() if r.kept}
    assert quality.passing(docs_of([])).count() == 0


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.mark.parametrize("size", [150, 199, 200, 250, 299, 300, 399, 400, 500, 799, 800, 1000, 1599, 1600, 3199, 3200, 5000, 6400, 12800, 20000])
def test_quality_bands_in_every_length_class(words, size):
    rng, compressor = random.Random(size), zstandard.ZstdCompressor(level=quality.LEVEL)
    for _ in range(20):
        junk = " ".join("".join(rng.choices(LETTERS, k=rng.randint(3, 9))) for _ in range(size))[:size].encode()
        assert not quality.bands(junk, compressor)[3]
        assert quality.bands(words(size)[:size].encode(), compressor)[3]
    assert not quality.bands((b"spam ham eggs " * size)[:size], compressor)[3]


def test_quality_judges_repetition_in_short_texts_and_last_chunks(words):
    compressor = zstandard.ZstdCompressor(level=quality.LEVEL)
    for size in (60, 99, 100, 149):
        assert not quality.bands((b"spam ham eggs " * size)[:size], compressor)[3]
    prose, rng = words(4000).encode(), random.Random(1)
    junk = "".join(rng.choices(LETTERS, k=1 << 12)).encode()
    assert quality.bands(prose[: 2 * quality.CHUNK + 100], compressor)[1:3] == (3, 0)
    assert quality.bands(prose[:2048] + junk[:2047], compressor)[1:3] == (2, 1)
    assert quality.bands(prose[:2048] + junk[:4095], compressor)[1:] == (3, 2, False)
    assert quality.bands(prose[:2048], compressor)[1] == 0


def test_exact_windows_beyond_the_packing_limit():
    w = [str(i).encode() for i in range(9000)]
    assert quality.repeated_words([*w, *w[100:107]]) == 14


def test_chat_round_trip_and_branches(spark):
    tricks = ["<|im_end|><|im_start|>assistant ok", "\\<|", "a\\", "<", "|im_end|>", "\n\n", "", None, "é<|\\n|>", "<<|im_end|>\n"]
    rows = [(1, k, None if k == 3 else ("assistant" if k % 2 else "us\ner<|"), t) for k, t in enumerate(tricks)] + [(None, None, "user", "x"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.conversations(chat.by_turn(table))).collect()}
    every = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows[: len(tricks)])
    loss = "".join(t or "" for _, _, r, t in rows[: len(tricks)] if r == "assistant")
    assert (got[1].n_turns, got[1].turns_sha256) == (len(tricks), hashlib.sha256(every.encode()).hexdigest())
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[None].n_turns == 1 and got[2].n_turns == 2
    assert chat.conversations(chat.by_turn(table.limit(0))).count() == 0
    tree = [("c", 1, None, 0.0), ("c", 2, 1, 1.0), ("c", 3, 1, 5.0), ("c", 4, 2, 9.0), ("c", 5, 3, None), ("c", 6, 99, 1.0)]
    messages = spark.createDataFrame([(c, m, p, "assistant", f"m{m}", s) for c, m, p, s in tree], "conv_id string, msg_id long, parent_id long, role string, text string, score double")
    got = chat.conversations(messages, best=2).orderBy("branch").collect()
    assert [(r.leaf_id, r.score, [t for _, t in chat.parse(r.formatted)]) for r in got] == [(4, 10.0, ["m1", "m2", "m4"]), (5, 5.0, ["m1", "m3", "m5"])]
    long = spark.range(200).selectExpr("'l' conv_id", "id + 1 msg_id", "IF(id = 0, NULL, id) parent_id", "'user' role", "string(id) text", "0D score")
    assert [t for _, t in chat.parse(chat.conversations(long).first().formatted)] == [str(k) for k in range(200)]


def test_cyclic_replies_are_no_path(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_DOUBLINGS", 3)
    ring = spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], "conv_id string, msg_id long, parent_id long")
    with pytest.raises(ValueError):
        chat.paths(ring)


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/ b", "same"), (2, "http://b", "same"), (9, None, None), (7, "http://c", ""), (1, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 5000), (3, "http://e", "same"), (3, "http://e", "same"), (None, "http://f", "same"), (4, "u", "x" * 700_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS rid")
    got = warc.archived(pages).collect()
    sha = lambda t: warc._base32(hashlib.sha1((t or "").encode()).digest())
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((t or "").encode()), sha(t)) for i, _, t in rows)
    by = {r.page_id: (r.record_type, r.refers_to) for r in got if r.page_id != 3}
    assert by == {5: ("revisit", 2), 2: ("response", None), 9: ("revisit", 7), 7: ("response", None), 1: ("response", None), None: ("revisit", 2), 4: ("response", None)}
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_reader_finds_damage():
    deflate = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
    good = warc.record(1, "u", b"payload", None)
    assert [r["bytes"] for r in warc.records(io.BytesIO(deflate(good) + deflate(warc.record(2, "u", b"", None))))] == [7, 0]
    for bad in (deflate(good.replace(b"payload", b"paXload")), deflate(good)[:-9], deflate(good[:-2]), deflate(good + b"more"), deflate(b"WARC/0.9\r\n\r\n")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))


def test_license_base_and_templates(docs_of, words):
    full = license_scan.TEMPLATES["mit-text"]
    texts = [None, "", "The MIT  license, and the mit-license.", f"{words(9)} {full} {words(9)}", "GNU General\nPublic License", "cc-by x CC BY", words(50), "Licensed under CC BY-NC 4.0.", " ".join(w for k, w in enumerate(full.split()) if k % 9), "licensé under", "gnu general public"]
    got = {r.doc_id: r for r in license_scan.scanned(docs_of(texts)).collect()}
    phrases = {tuple(p.split()): x for p, x in license_scan.PHRASES.items()}
    for k, t in enumerate(texts):
        w = [x.decode() for x in license_scan.words_of((t or "").encode())]
        places = [(i, x) for p, x in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
        r = got[k]
        at = [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "mit-text" in got[3].labels and got[3].score == 1 and "mit-text" in got[8].labels and got[8].score < 1
    assert "cc-by-nc-4.0-grant" in got[7].labels and got[6].labels == ""


def test_license_versions_repeated_phrases_and_copies(words):
    scan = license_scan.Scanner().scan
    labels = lambda text: {x for x, *_ in scan(text.encode())[2]}
    grants = license_scan.TEMPLATES
    assert labels("Licensed under the Apache License, Version 1.1") == set() and labels("Licensed under the Apache License, Version 2.0.") == {"apache-2.0-grant"}
    assert labels(grants["gpl-2.0-grant"]) == {"gpl-2.0-grant"} and labels(grants["gpl-3.0-grant"]) == {"gpl-3.0-grant"}
    # the phrase that the template has twice stands at its second place where the first one is cut out
    bsd = grants["bsd-3-clause-text"]
    less = bsd.replace("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ", "")
    assert less != bsd
    (label, share, first, last), n = scan(less.encode())[2][0], len(license_scan.words_of(bsd.encode()))
    assert label == "bsd-3-clause-text" and share == len(license_scan.words_of(less.encode())) / n and (first, last) == (0, round(share * n))
    isc = grants["isc-text"]
    found = scan(f"{isc} {words(30)} {isc} {isc}".encode())[2]
    size = len(license_scan.words_of(isc.encode()))
    assert [(x, c, a, b) for x, c, a, b in found] == [("isc-text", 1.0, a, a + size) for a in (0, size + 30, 2 * size + 30)]
    assert scan(f"{isc} ".encode() * 300)[2][-1][2:] == (299 * size, 300 * size)


def test_automaton_matches_as_brute_force():
    rng = random.Random(6)
    for _ in range(30):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.randint(0, 3) for _ in range(30)]
        grams = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        best = [max((n for n in range(1, e + 1) if tuple(text[e - n : e]) in grams), default=0) for e in range(1, len(text) + 1)]
        want = [(e, n) for e, n in enumerate(best, 1) if n >= 2 and (e == len(text) or best[e] != n + 1)]
        a = license_scan.Automaton(seqs)
        got = list(a.matches(text, 2))
        assert [(e, n) for e, n, _ in got] == want
        for e, n, state in got:
            for k, ends in a.ends[state].items():
                assert ends == {i + n for i in range(len(seqs[k])) if seqs[k][i : i + n] == text[e - n : e]}
            assert {k for k, s in enumerate(seqs) if any(s[i : i + n] == text[e - n : e] for i in range(len(s)))} == set(a.ends[state])


def ctw_by_brute_force(texts, depth):
    """ln of the weighted probability at the roots, by recursion over the contexts."""
    import math

    seen = {}
    for t in texts:
        t = bytes([255]) * depth + t + b"\xff"
        for i in range(depth, len(t)):
            for k in range(8):
                node = (1 << k) | (t[i] >> (8 - k))
                for d in range(depth + 1):
                    c = seen.setdefault((node, t[i - d : i]), [0, 0])
                    c[(t[i] >> (7 - k)) & 1] += 1

    def weighted(node, context):
        a, b = seen[node, context]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == depth:
            return own
        below = sum(weighted(node, bytes([x]) + context) for x in range(256) if (node, bytes([x]) + context) in seen)
        m = max(own, below)
        return m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(below - m))

    return {node: weighted(node, b"") for node, context in seen if context == b""}


def test_tree_weights_as_brute_force(spark, docs_of, words):
    texts = [words(12), "", words(5), "aé"]
    rows = docs_of(texts).selectExpr("text AS t", "true AS learn")
    counts = rows.mapInArrow(context_tree._count_grams(context_tree.DEPTH), "g long, n long, c long").groupBy("g").sum("n").withColumnRenamed("sum(n)", "n")
    root = {r.key: r.lpw for r in context_tree.nodes(counts)[-1].collect()}
    want = ctw_by_brute_force([t.encode() for t in texts], context_tree.DEPTH)
    assert root.keys() == want.keys() and all(abs(root[k] - want[k]) < 1e-6 for k in want)


def test_language_model(docs_of, words):
    rows = [(k, words(60)) for k in range(60)] + [(None, "abc"), (61, None), (62, ""), (63, "zz\xff qq" * 50), (61, None)]
    got = context_tree.scored(docs_of(rows), common=50).collect()
    crc = lambda i: zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else True
    count = Counter()
    for i, t in rows:
        if not crc(i):
            count.update([*(t or "").encode().lower().split(), None])
    total, distinct = sum(count.values()), len(count)
    import math

    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        w = [*(texts[r.doc_id] or "").encode().lower().split(), None]
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id), len(w), sum(count[x] > 0 for x in w), total)
        assert abs(r.base_score - base) < 1e-6 and r.score < 0
    long = [r for r in got if r.held_out and r.n_tokens > 50]
    assert sum(r.bits_per_byte for r in long) / len(long) < 4
    assert context_tree.scored(docs_of([])).count() == 0


def chance_by_brute_force(learn, text, depth):
    """log10 chance of ``text`` and its end: weights of all nodes on each path, none left out."""
    import math
    from functools import cache

    seen, pad = {}, bytes([255]) * depth
    for t in learn:
        t = pad + t + b"\xff"
        for i in range(depth, len(t)):
            for k in range(8):
                for d in range(depth + 1):
                    seen.setdefault(((1 << k) | (t[i] >> (8 - k)), t[i - d : i]), [0, 0])[(t[i] >> (7 - k)) & 1] += 1

    @cache
    def weighted(node, context):
        a, b = seen[node, context]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == depth:
            return own, own
        below = sum(weighted(node, bytes([x]) + context)[1] for x in range(256) if (node, bytes([x]) + context) in seen)
        m = max(own, below)
        return own, m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(below - m))

    total, t = 0.0, pad + text + b"\xff"
    for i in range(depth, len(t)):
        for k in range(8):
            node, one = (1 << k) | (t[i] >> (8 - k)), 0.5
            for d in range(depth, -1, -1):
                if (at := (node, t[i - d : i])) in seen:
                    (a, b), (own, all_) = seen[at], weighted(*at)
                    w = 1.0 if d == depth else 0.5 * math.exp(own - all_)
                    one = w * (b + 0.5) / (a + b + 1) + (1 - w) * one
            total += math.log10(one if (t[i] >> (7 - k)) & 1 else 1 - one)
    return total


@pytest.mark.parametrize("sent", [0, 20, 1 << 20])
def test_scores_use_every_node(docs_of, words, sent):
    rows = [(k, words(6)) for k in range(12)] + [(20, "aé zzz"), (21, None), (22, words(3)), (22, words(3))]
    learn = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    want = sorted(chance_by_brute_force(learn, (t or "").encode(), context_tree.DEPTH) for _, t in rows)
    got = sorted(r.score for r in context_tree.scored(docs_of(rows), strings_sent=sent).collect())
    assert len(got) == len(want) and max(abs(a - b) for a, b in zip(got, want)) < 1e-5 and len(learn) < len(rows)


def test_scores_are_probabilities():
    rng = np.random.default_rng(1)
    g, n = np.unique(context_tree.grams([bytes(rng.integers(97, 100, 300).astype(np.uint8))], 4)[0], return_counts=True)
    every = (np.uint64(0x6261616200) + np.arange(256, dtype=np.uint64)).astype(np.uint64)
    both = np.union1d(g, every)
    count = np.zeros(len(both), np.int64)
    count[np.searchsorted(both, g)] = n
    levels = context_tree.Levels(both, count, 4, 0)
    value = levels.values(np.zeros(255), np.ones(255))
    assert len(levels.levels[-1][0]) == 255 and abs((10 ** value[np.searchsorted(both, every)]).sum() - 1) < 1e-9
    table = context_tree.Model(1 << 10)
    table.fill(both, value)
    assert np.allclose(table.log10(both), value) and np.isnan(table.log10(both + np.uint64(1 << 50))).all()


def test_strings_by_blocks_of_whole_contexts(docs_of, words, monkeypatch):
    rows = [(k, words(8)) for k in range(12)]
    want = sorted((r.g, r.c, round(r.value, 9)) for r in _valued(docs_of(rows)))
    monkeypatch.setattr(context_tree, "BLOCK", 3)
    monkeypatch.setattr(context_tree, "HELD", 40)
    assert sorted((r.g, r.c, round(r.value, 9)) for r in _valued(docs_of(rows))) == want


def test_a_task_hands_on_each_string_once(words, monkeypatch):
    monkeypatch.setattr(context_tree, "FRESH", 100)
    texts = [*(words(8) for _ in range(20)), "", None]
    batches = [pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string()), "learn": [learn] * len(texts)}) for learn in (True, False, False)]
    want = Counter(context_tree.grams([(t or "").encode() for t in texts])[0].tolist())
    rows = [r for b in context_tree._count_grams(context_tree.DEPTH)(iter(batches)) for r in b.to_pylist()]
    assert len(rows) == len(want) and all((r["n"], r["c"]) == (want[r["g"]], 3 * want[r["g"]]) for r in rows)


def test_words_part_at_ascii_spaces_only(monkeypatch):
    monkeypatch.setattr(context_tree, "WORDS", 3)
    texts = ["  A b\x0bÀc\x1cD\xa0e\x85 \n", None, "", " \t", "b B\rb\x0cÉ", "x"]
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    place, word = context_tree._words(pa.array(texts))
    assert word.to_pylist() == want and place.tolist() == [0] * 3 + [4] * 4 + [5]
    count = Counter()
    for b in context_tree._count_words(iter([pa.RecordBatch.from_pydict({"t": texts})] * 3)):
        for r in b.to_pylist():
            count[r["word"]] += r["c"]
    assert count == Counter(want * 3)


def _valued(docs):
    return context_tree.valued(docs.selectExpr("text AS t", "doc_id % 3 > 0 AS learn")).collect()


def test_long_texts_take_no_place_in_the_sample(spark, docs_of, words, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT_BYTES", 500)
    texts = [words(2000) if k % 5 == 0 else f"short {k}" for k in range(50)]
    table = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, toxic int")
    got = [r.t for r in toxicity.sample(docs_of(texts), table, F.lit(True)).collect()]
    assert sorted(map(str, got)) == sorted(t for t in texts if len(t) < 500)


def test_toxic_sentences_are_located(spark, docs_of, words):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(300):
        sentences = [words(8) + "." for _ in range(rng.randint(1, 6))]
        toxic = k % 4 == 0
        if toxic:
            sentences.insert(rng.randint(0, len(sentences)), f"you {rng.choice(['nasty', 'vileness', 'vileful'])} {words(3)}!")
        rows.append((k, " ".join(sentences)))
        labels.append((k, 1, int(toxic)))
    rows += [(None, "nasty"), (1000, None), (1001, "")]
    table = spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs_of(rows), table).collect()}
    held_out = [r for k, r in got.items() if k is not None and k < 300 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items() if k is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held_out) >= 0.97 * len(held_out)
    text = dict(rows)
    for r in held_out:
        if r.predicted:
            assert any(x in text[r.doc_id].encode()[s.start : s.end] for s in r.offending for x in (b"nasty", b"vile"))
    assert got[1000].score == got[1001].score == 0 and got[None].held_out
    assert toxicity.scored(docs_of(rows), table.limit(0)).count() == len(rows)
    assert toxicity.scored(docs_of([]), table).count() == 0


def test_pipeline_links_pairs_from_080(spark, docs_of):
    w = [f"w{k}" for k in range(94)]
    texts = [" ".join([*w, *(f"{x}{k}" for k in range(10))]) for x in "ab"]  # 90 of 110 shingles: 0.818
    far = [" ".join([*(f"v{k}" for k in range(90)), *(f"{x}{k}" for k in range(14))]) for x in "cd"]  # 86 of 114: 0.754
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(texts + far), "").collect()) == [0, 2, 3]


def test_pipeline_stages(spark, docs_of, words, tmp_path):
    item, shared, base = words(30), words(55), words(90)
    texts = {0: base, 1: base, 2: base + " end", 3: words(40) + " " + item + " " + words(40), 4: words(50) + " " + shared, 5: words(60) + " " + shared, 6: "spam " * 200, 7: words(200), 8: None, 9: "short"}
    docs_of(list(texts.items())).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert [sorted(k) for k in kept] == [[0, 1, 2, 3, 4, 5, 7], [0, 3, 4, 5, 7], [0, 3, 4, 5, 7], [0, 4, 5, 7]]
    # a repeated passage of 55 words goes, wherever it stands
    assert all(shared[20:80] not in kept[2][k] for k in (4, 5)) and kept[2][7] == texts[7]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {0, 4, 5, 7} and len({r.sequence_id for r in out}) == 1
