import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(3)
    pool = [*"aAeEtT  \n\t'sdlmvr.,-0129", "é", "ß", "中", "文", "　", "\x1c", "\x85", "​", "١", "😀", "👩‍💻", "́", "ՠ", "꟎", "\U00010940", "<|endoftext|>", "'ll", "'S", "  "]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(400)]
    return texts + [
        "", " ", "\n\n\n", "a", "aaaaaaaaaaaaaaaa", "aaaaa" * 999, "<|endoftext|>", "x<|endoftext|><|endoftext|> y ", "  <|endoftext|>  a", "<|endoftext", "it's 'twas I'LL we'll'd",
        "na" * 500 + " " + "ab" * 77, "\x00\x01\x7f", "é" * 20, "".join(rng.choices("abcdefgh", k=3000)), " " * 300 + "x" + " " * 200, "ﬀ ﬁ Ⅷ ² ½",
    ]


def test_ids_and_texts_as_the_library_gives(library):
    bpe = byte_bpe.ByteBpe(PATH)
    texts = odd_texts()
    for batch in (texts, texts[::-1], texts[:3]):
        ids = bpe.encode(batch)
        assert [x.tolist() for x in ids] == [library.encode(t, add_special_tokens=False).ids for t in batch]
        back = bpe.decode(np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids])))
        assert back == [library.decode(x.tolist(), skip_special_tokens=False) for x in ids] == batch


def test_characters_of_all_planes_split_as_the_library_does(library):
    bpe = byte_bpe.ByteBpe(PATH)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    texts = ["".join(x + rng.choice(["", "", " ", "a", "7", "!"]) for x in every[k : k + 50]) for k in range(0, len(every), 2003)]
    assert [x.tolist() for x in bpe.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_between_words(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECE_CHARS", 7)
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "KEPT_CHARS", 3)
    bpe = byte_bpe.ByteBpe(PATH)
    for t in [*odd_texts(), "abc  \n\n def   ", "abcdefghijklmnop", "   abcdefghijklmn     " * 9]:
        assert bpe.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(bpe.words) <= 5


def test_a_long_word_and_a_long_text(library):
    rng = random.Random(8)
    text = "".join(rng.choices("etaoinshrdlu", k=60_000)) + " " + " ".join("".join(rng.choices("etaoin", k=5)) for _ in range(300_000))
    assert byte_bpe.ByteBpe(PATH).encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_any_ids(library):
    rng = np.random.default_rng(4)
    bpe = byte_bpe.ByteBpe(PATH)
    lists = [rng.integers(0, 50257, n) for n in (0, 1, 5, 300, 0)] + [np.array([188, 50256, 188, 0]), np.arange(256)]
    ends = np.append(0, np.cumsum([len(x) for x in lists]))
    assert bpe.decode(np.concatenate(lists), ends) == [library.decode(x.tolist(), skip_special_tokens=False) for x in lists]
    assert bpe.decode(np.array([-1, 64, 50257, 65, 1 << 31]), np.array([0, 3, 5])) == ["a", "b"]


def test_rows_of_tables(spark, library, docs_of):
    texts = [None, "", "a b", "a b", *odd_texts()[:20]]
    docs = docs_of([(k if k != 3 else None, t) for k, t in enumerate(texts)])
    for name in ("ids", "decoded", "n"):
        docs = docs.withColumn(name, F.lit(name))
    got = byte_bpe.digests(byte_bpe.round_trip(docs, PATH)).collect()
    want = []
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((k if k != 3 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert [tuple(r) for r in got] == want
    rows = byte_bpe.encoded(docs, PATH)
    assert [r.text for r in byte_bpe.decoded(rows, PATH).collect()] == [t or "" for t in texts]
    assert byte_bpe.decoded(rows.withColumn("ids", F.lit(None).cast("array<int>")).limit(1), PATH).first().text == ""
    assert byte_bpe.digests(byte_bpe.round_trip(docs.limit(0), PATH)).count() == 0
