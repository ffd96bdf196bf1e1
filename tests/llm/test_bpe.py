import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from steadyframes.llm import bpe
from steadyframes.llm.textbytes import blocks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
_A, _B = "a", "b"
while len(_A) < 4096:
    _A, _B = _A + _B, _B + _A
#: Strings of two letters whose polynomial hashes modulo a power of two are equal.
TWINS = [f" {_A[:n]} {_B[:n]}" for n in (1024, 2048, 4096)]
TEXTS = [*TWINS, "", "Hello, world!  It's  a test\n\n x", "naïve 中文 texte  　 fin 😀😀", "a" * 3000, " \t\n ", "don't 12345 !!!???", "x'll 'S"]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_transducer_equals_the_plain_merges():
    m = bpe.Merges(bpe.read_ranks(PATH))
    t = bpe.Transducer(m)
    r = random.Random(2)
    for _ in range(3000):
        w = "".join(r.choice("abcdefiornst THE'é中1") for _ in range(r.randint(1, 14))).encode()
        assert t.encode(w) == ([m.ranks[w]] if w in m.ranks else m.merge(w))


def test_many_at_once_equal_one_by_one():
    m = bpe.Merges(bpe.read_ranks(PATH))
    r = random.Random(3)
    words = list(dict.fromkeys("".join(r.choice("abcdefiornst THE'é中1") for _ in range(r.choice((1, 5, 14, 1200)))).encode() for _ in range(400)))
    flat, counts = bpe.Transducer(m).encode_many(words)
    t, at = bpe.Transducer(m), 0
    for w, n in zip(words, counts.tolist(), strict=True):
        assert flat[at : at + n].tolist() == t.encode(w)
        at += n
    assert [len(x) for x in bpe.Transducer(m).encode_many([])] == [0, 0]


def test_random_texts_equal_tiktoken(oracle):
    r = random.Random(5)
    texts = ["".join(r.choice("ab  \n\t'sdlltre12 éß中\u2009\u3000\x1c\x7f.,!-😀THE\r\xa0") for _ in range(r.randint(0, 60))) for _ in range(5000)]
    c = bpe.Coder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for _, _, buf, offsets in blocks(pa.array(texts)):
        ids, rows = c.block(buf, offsets)
        got = [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)]
    assert got == [oracle.encode_ordinary(t) for t in texts]


def test_a_full_memory_forgets_what_was_not_used_for_longest(monkeypatch, oracle):
    monkeypatch.setattr(bpe, "MAX_PIECES", 8)
    monkeypatch.setattr(bpe, "MAX_WORDS", 4)
    c = bpe.Coder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for k in range(60):
        t = f"the same words and number {k * 7919} again, nr {k}"
        assert c.ids(t) == oracle.encode_ordinary(t)
    assert b" same" in c.pieces.number and len(c.pieces.number) < 30


def test_states_may_be_dropped_at_any_time(monkeypatch):
    m = bpe.Merges(bpe.read_ranks(PATH))
    want = bpe.Transducer(m).encode(b"abcdefgh" * 700)
    many = bpe.Transducer(m).encode_many([b"fghijk", b"abcdxyz" * 30])[0].tolist()
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    assert bpe.Transducer(m).encode(b"abcdefgh" * 700) == want
    assert bpe.Transducer(m).encode_many([b"fghijk", b"abcdxyz" * 30])[0].tolist() == many


def test_digests_equal_tiktoken(spark, oracle):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (1, TEXTS[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in bpe.digests(df, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in docs:
        ids = oracle.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_table_and_column(spark, oracle):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, "y")], "doc_id long, text string, n_tokens string")
    for r in bpe.encode_table(df, PATH, public_tokenizers.PATTERN).collect():
        t = TEXTS[r.doc_id] if r.doc_id < 90 else ""
        assert r.token_ids == oracle.encode_ordinary(t) and r.n_tokens == len(r.token_ids) and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    for r in bpe.encode_column(df, "text", PATH, public_tokenizers.PATTERN, "ids", "back").collect():
        assert r.ids == oracle.encode_ordinary(r.text or "") and r.back == (r.text or "")


def test_stream_decoder_holds_unfinished_characters():
    d = bpe.StreamDecoder({0: b"\xe4\xb8", 1: b"\xad!", 2: b"\xff", 3: b"\xf0\x9f"})
    assert [d.feed(0), d.feed(1), d.feed(2), d.feed(3), d.finish()] == ["", "中!", "�", "", "�"]
