import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import near_dedup, rindex, setsketch, suffix_dedup
from tidemark.llm.shingles import shingle_sets


def removed_by_brute_force(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-1])[:-1]).sum()) if len(t) else 0
        at, whole = 0, ""
        for c in t.decode():
            n = len(c.encode())
            whole += "" if gone[at : at + n].any() else c
            at += n
        out.append((len(t), int(gone[: len(t)].sum()), spans, hashlib.sha256(kept).hexdigest(), whole))
    return out


def cases(words):
    shared, other = words(40), words(60)
    base = words(120)
    return [
        None, "", "kurz", "ab" * 300, "x" * 900, words(200), base, base, base[:300] + words(30) + base[300:],
        words(10) + shared + words(10), words(3) + shared, shared + other, other + shared, other + "ü" + shared[1:],
        shared[:99], shared[:100], "ä" * 120 + words(5), words(2) + "ä" * 120, "y" + "ab" * 60,
    ]


@pytest.mark.parametrize("options", [{}, {"hot_bytes": 200}, {"bucket_bytes": 500}, {"anchor": 30}])
def test_repeated_strings_as_brute_force(docs_of, words, options):
    texts = cases(words)
    got = suffix_dedup.removed(docs_of(texts), **({"length": 100, "anchor": 60} | options)).collect()
    want = removed_by_brute_force(texts, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in got} == dict(enumerate(want))


def test_repeated_rows_nulls_and_names(spark, docs_of, words):
    text = words(60)
    docs = docs_of([(1, text), (1, text), (None, text), (None, None), (4, words(60))])
    for name in ("i", "k", "t", "h", "spans", "row"):
        docs = docs.selectExpr("*", f"'{name}' AS {name}")
    got = suffix_dedup.strip(docs, length=100, anchor=60)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.doc_id or -1, r.text or "", r.text is None) for r in rows)[:4] == [(-1, "", False), (-1, "", True), (1, "", False), (1, "", False)]
    assert all(r.h == "h" and r.row == "row" for r in rows)
    assert suffix_dedup.removed(docs.limit(0)).count() == 0
    assert suffix_dedup.strip(docs.limit(0)).count() == 0


def test_run_index_marks_and_compresses():
    rng = random.Random(1)
    base = bytes(rng.choices(b"acgt", k=3000))
    texts = [base, base[:1500] + b"xx" + base[1500:], b"", bytes(rng.choices(b"acgt", k=500)), b"ab" * 400]
    index = rindex.RunIndex(texts, 50)
    assert len(index.run_starts) < index.size / 1.3
    seen = Counter(t[i : i + 50] for t in texts for i in range(len(t) - 49))
    for t, spans in zip(texts, index.repeated()):
        want = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - 49):
            if seen[t[i : i + 50]] > 1:
                want[i : i + 50] = True
        got = np.zeros(len(t), dtype=bool)
        for s, e in spans:
            got[s:e] = True
        assert (got == want).all()


def test_suffix_array_sorts():
    rng = np.random.default_rng(3)
    for n, top in ((1, 2), (50, 2), (400, 3), (300, 200)):
        s = rng.integers(0, top, n)
        assert suffix_order(s) == rindex.suffix_array(s).tolist()


def suffix_order(s):
    return sorted(range(len(s)), key=lambda i: s[i:].tolist())


def shingles(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [(i, len(s), min(rows[j][0] for j in range(len(rows)) if find(j) == find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def mutated(text, rng, share):
    return " ".join(w if rng.random() > share else f"new{rng.random():.9f}" for w in text.split())


@pytest.mark.parametrize("large", [32, 1])
def test_near_duplicates_as_brute_force(docs_of, words, large, monkeypatch):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "RARE", 2 if large == 1 else 16)
    rng = random.Random(9)
    texts = [None, "", " \n", "one two", "ONE\tTWO", "one two three four five", "x"]
    for _ in range(6):
        base = words(rng.randint(30, 200))
        texts += [mutated(base, rng, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06])) for _ in range(15)]
    rng.shuffle(texts)
    rows = [(3 * k % 1000, t) for k, t in enumerate(texts)] + [(7, texts[0]), (8, texts[1])]
    got = near_dedup.groups(docs_of(rows)).collect()
    want = components_by_brute_force(rows)
    alone = {i for i, n, _ in want if n == 0}
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, n, i if i in alone and n == 0 else c) for i, n, c in want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_of_each_group_stays(docs_of, words):
    text = words(50)
    docs = docs_of([(5, text), (2, text + " "), (2, text + " "), (9, None), (9, None), (None, words(50)), (3, "")])
    for name in ("x", "n", "row", "component_id"):
        docs = docs.selectExpr("*", f"'{name}' AS {name}")
    got = near_dedup.one_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 2, 3, 9, 9]
    assert near_dedup.groups(docs.limit(0)).count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2)
    for common in (0, 1000, 1800, 2000):
        a, b = np.unique(pool[:2000]), np.unique(pool[2000 - common : 4000 - common])
        s = setsketch.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = common / (4000 - common)
        got = setsketch.jaccard(s[:1], s[1:], np.array([2000.0]), np.array([2000.0]))[0]
        assert abs(got - true) < 0.16
        union = np.unique(np.concatenate([a, b]))
        assert (setsketch.merge(s[0], s[1]) == setsketch.sketches(union, np.array([0, len(union)]))[0]).all()


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word


def test_texts_with_one_polynomial_hash_stay_apart(docs_of):
    """A Thue-Morse word and its complement share every polynomial hash modulo 2**64 from 1024 letters on."""
    one = thue_morse(4096)
    other = one.translate({97: 98, 98: 97})
    assert len(shingle_sets([f"{one} {other}".encode(), f"{one} {one} {one} {one} {one} {other}".encode()])[0]) == 3
    got = near_dedup.groups(docs_of([one, other, one + " ", f"x {one} a b c d", f"x {other} a b c d"])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (2, 3), 4: (2, 4)}
    texts = [one[:1500], other[:1500], "q" + one[:1024], "z" + other[:1024]]
    got = suffix_dedup.removed(docs_of(texts), length=1024, anchor=60).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.text) for r in got} == dict(enumerate(removed_by_brute_force(texts, 1024)))


def test_shingles_in_batches():
    texts = [b"", b"a b", b"A b c d e f a b c d e", b"  ", b"q\x0bw\x1ce r t y"]
    hashes, offsets = shingle_sets(texts)
    assert np.diff(offsets).tolist() == [len(shingles(t.decode())) for t in texts]
