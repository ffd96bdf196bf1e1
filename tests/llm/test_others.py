"""Token files, media, token counts, LM scoring and tool calls against plain versions."""

import hashlib
import io
import itertools
import json
import math
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from steadyframes.llm import lmscore, media, tokencount, tokenfile, toolcalls
from steadyframes.llm.bpe import read_ranks
from steadyframes.llm.components import shared_folder

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
_A, _B = "a", "b"
while len(_A) < 4096:
    _A, _B = _A + _B, _B + _A
#: Words of two letters whose polynomial hashes modulo a power of two are equal.
TWINS = [f"{_A[:n]} {_B[:n]}" for n in (1024, 2048, 4096)]
TEXTS = ["Hello there, World's end. it's", None, "", "  é中 ΑΣ  x|y <|endoftext|> A.B", "word " * 3000, "Hello there, World's end. it's", *TWINS]


# --- token files


def test_values_survive_coding():
    rng = np.random.default_rng(3)
    v = (rng.integers(0, 2**32, 5003, dtype=np.uint64) >> rng.integers(0, 32, 5003).astype(np.uint64)).astype(np.uint32)
    assert (tokenfile.unpack(*tokenfile.pack(v), len(v)) == v).all()
    ids = rng.zipf(1.3, 4000).clip(0, 40000).astype(np.uint32)
    ranked = tokenfile.ranking(np.bincount(ids))
    rank = np.zeros(int(ids.max()) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked))
    control, data = tokenfile.code_block(ids, rank)
    assert (tokenfile.decode_block(ranked.astype(np.uint32), control, data, len(ids)) == ids).all()
    assert ranked[0] == np.bincount(ids).argmax() and len(data) < 2 * len(ids)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_token_file_equals_the_library(spark, monkeypatch, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "BLOCK_TOKENS", block)
    own = Tokenizer.from_file(WORDS)
    rows = [(10 * (7 - i), t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (70, TEXTS[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    got = sorted(tokenfile.digest(df, WORDS).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (i, t) in zip(got, ordered, strict=True):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.digest(df.where("false"), WORDS).count() == 0


# --- media


def _bmp(image, bits, top_down=False):
    h, w = image.shape[:2]
    row = (w * bits + 31) // 32 * 4
    palette = b"".join(bytes([v, v, v, 0]) for v in range(256)) if bits == 8 else b""
    body = b""
    for y in range(h) if top_down else range(h - 1, -1, -1):
        line = image[y].tobytes() if bits == 8 else image[y][:, ::-1].tobytes()
        body += line + bytes(row - len(line))
    start = 54 + len(palette)
    return b"BM" + (start + len(body)).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + (40).to_bytes(4, "little") + w.to_bytes(4, "little") + (-h if top_down else h).to_bytes(4, "little", signed=True) + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + bytes(24) + palette + body


def test_decoders():
    rng = np.random.default_rng(1)
    g, c = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(g)) == g).all()
    assert (media.decode(b"P6 # note\n7 5\n255\n" + c.tobytes()) == c).all()
    assert (media.decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % v for v in g.ravel())) == g).all()
    assert (media.decode(b"P3\n7 5\n255\n" + b" ".join(b"%d" % v for v in c.ravel())) == c).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P5\n1 1\n1000\n\x01\x02").tolist() == [[258]]
    for top in (False, True):
        assert (media.decode(_bmp(g, 8, top)) == g).all() and (media.decode(_bmp(c, 24, top)) == c).all()
    for bad in (b"", b"P5\n0 1\n255\n", b"P5\n9 9\n255\nxx", b"BMxx", b"GIF"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_equals_the_sum_over_parts_of_pixels():
    rng = np.random.default_rng(2)
    for (h, w), (a, b) in itertools.product([(5, 7), (16, 9), (1, 3)], [(3, 2), (8, 9), (1, 1)]):
        g = rng.integers(0, 256, (h, w)).astype(float)

        def part(n, m):
            return np.array([[max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)])

        want = part(h, a) @ g @ part(w, b).T * (a * b / (h * w))
        assert np.allclose(media.area_resize(g, a, b), want)


def test_media_digest_and_tiles(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in media.digest(df).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes > r.payload_bytes
    assert got[0][2:] == got[5][2:]
    images = spark.createDataFrame([(1, media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8)), "k"), (2, None, "k"), (3, b"junk", "k")], "id long, content binary, tile string")
    out = media.tiles(images, size=8, tile=4).collect()
    assert [r.error for r in out if r.id == 2] == ["null"] and len([r for r in out if r.id == 3]) == 1
    own = {(r.tile_y, r.tile_x): np.load(io.BytesIO(r.tile)) for r in out if r.id == 1}
    assert (np.block([[own[0, 0], own[0, 1]], [own[1, 0], own[1, 1]]]) == np.arange(64).reshape(8, 8)).all()


def test_media_digest_reads_stored_files(spark, monkeypatch, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    kept, read = [], media.stored
    monkeypatch.setattr(media, "stored", lambda s, folder: kept.append(folder) or read(s, folder))
    got = {r.doc_id: r for r in media.digest(df).collect()}
    rows = spark.read.parquet(kept[0]).collect()
    assert len(kept) == 1 and len(rows) == len(TEXTS)
    for r in rows:
        image = media.decode(bytes(r.media))
        assert image.tobytes().rstrip(b"\0") == (TEXTS[r.doc_id] or "").encode() and got[r.doc_id].media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert (np.load(io.BytesIO(r.tile)) == np.clip(np.rint(media.area_resize(image, 16, 16)), 0, 255)).all()
        assert got[r.doc_id].feature == f"{r.dhash}:{zlib.crc32(r.tile):08x}"
    # Another text's media in the files, with its own tile, shows in the digests; without it, or cut short, it stops the query.
    other = next(r for r in rows if r.doc_id == 4)
    schema = media.stored(spark, kept[0]).schema
    swapped = spark.createDataFrame([(0, 1, other.media, other.dhash, other.tile)], schema)
    assert media.features(swapped).first().payload_sha256 == got[4].payload_sha256 != got[0].payload_sha256
    for data, tile in ((other.media, rows[0].tile if rows[0].doc_id != 4 else rows[1].tile), (other.media[:-9], other.tile)):
        with pytest.raises(Exception, match="stored tile|buffer"):
            media.features(spark.createDataFrame([(0, 1, data, other.dhash, tile)], schema)).collect()


# --- token counts


def test_token_counts_equal_plain_dynamic_programming(spark):
    scores, unknown = tokencount.entry_scores(read_ranks(RANKS))
    texts = [*TEXTS, "zzzzqqq thereunto 中\x00\x01", "a" * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in tokencount.count_column(df, RANKS).collect()}
    import pyarrow as pa

    from steadyframes.llm.textbytes import blocks, chunk_spans

    def best(piece):
        f = [(0, 0)]
        for j in range(1, len(piece) + 1):
            options = [(f[j - 1][0] + unknown, f[j - 1][1] - 1)]
            options += [(f[j - n][0] + scores[piece[j - n : j]], f[j - n][1] - 1) for n in range(1, min(j, tokencount.LONGEST) + 1) if piece[j - n : j] in scores]
            f.append(max(options))
        return f[-1][0], -f[-1][1]

    for i, t in enumerate(texts):
        pieces = []
        for _, _, buf, offsets in blocks(pa.array([t or ""])):
            s, e, _ = chunk_spans(buf, offsets)
            pieces = [buf[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        assert b"".join(pieces) == (t or "").encode()
        parts = [best(p) for p in pieces]
        assert (got[i].n_pretokens, got[i].n_tokens, got[i].score) == (len(pieces), sum(n for _, n in parts), sum(s for s, _ in parts))
    assert tokencount.digest(df.where("false"), RANKS).count() == 0


def test_long_entries_are_tokens(spark):
    ranks = read_ranks(RANKS)
    scores, _ = tokencount.entry_scores(ranks)
    assert scores.keys() == ranks.keys()
    long = [w.decode() for w in ranks if len(w) > 16 and w.isascii() and (w[:1] == b" " or not w[:1].isspace()) and not w[1:].strip(b"\n ") == b"" and b" " not in w[1:]]
    assert max(map(len, long)) >= 64 and " responsibilities" in long and "-" * 64 in long
    got = {r.doc_id: r for r in tokencount.digest(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), RANKS).collect()}
    for i, w in enumerate(long):
        assert (got[i].n_pretokens, got[i].n_tokens, got[i].score) == (1, 1, scores[w.encode()]), w


# --- LM scoring


def test_lm_beats_the_counts_on_unseen_texts_and_sums_to_one(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    make = lambda: " ".join(itertools.chain.from_iterable((words[k], words[(k * 7 + 3) % 40]) for k in rng.integers(0, 40, 60)))
    train = spark.createDataFrame([(i, make()) for i in range(1500)], "doc_id long, text string").repartition(4)
    unseen = spark.createDataFrame([(i, make()) for i in range(50)], "doc_id long, text string")
    plain, m = lmscore.fit(train, rounds=0), lmscore.fit(train)
    mean = lambda model: lmscore.score(unseen, model).agg(F.sum("log_likelihood") / F.sum("n_words")).first()[0]
    assert mean(m) > mean(plain) + 0.1
    share = np.exp(m.share)
    assert np.allclose(np.bincount(m.leaf_of, weights=share)[np.unique(m.leaf_of)], 1)


def test_lm_equals_a_loop_over_words(spark):
    import pyarrow as pa

    df = spark.createDataFrame([(0, "a b a c b. D"), (1, None), (2, ""), (3, "one")], "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    m = lmscore.fit(df)
    got = {r.doc_id: r for r in lmscore.score(df, m).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].log_likelihood == 0 and got[1].per_word is None
    (h, rows), total = next(lmscore.words_of(pa.array(["a b a c b. D"]))), 0.0
    number = [int(x) % lmscore.INPUTS for x in h]
    for t in range(len(h)):
        near = [number[t + s] if 0 <= t + s < len(h) else lmscore.INPUTS for s in (-2, -1, 1, 2)]
        z = np.tanh(sum(m.embed[n] @ m.mix[k] for k, n in enumerate(near)) + m.hidden) @ m.out + m.bias
        bucket = int(h[t]) >> 40 & lmscore.BUCKETS - 1
        c, leaf = divmod(int(m.leaf_of[bucket]), lmscore.LEAVES)
        y = np.tanh(sum(m.embed[n] @ m.mix[k] for k, n in enumerate(near)) + m.hidden) @ m.low[c] + m.low_bias[c]
        total += z[c] - math.log(np.exp(z).sum()) + y[leaf] - math.log(np.exp(y).sum()) + m.share[bucket]
    assert got[0].n_words == 6 and abs(got[0].log_likelihood - total) < 1e-3
    assert lmscore.digest(df.where("false")).count() == 0


@pytest.mark.parametrize("frequent", [lmscore.FREQUENT, 1])
def test_words_of_one_bucket_have_own_probabilities(spark, monkeypatch, frequent):
    import pyarrow as pa

    monkeypatch.setattr(lmscore, "FREQUENT", frequent)
    (h, _), by = next(lmscore.words_of(pa.array([" ".join(f"w{i}" for i in range(3000))]))), {}
    for i, x in enumerate(h.tolist()):
        by.setdefault(x >> 40 & lmscore.BUCKETS - 1, []).append(f"w{i}")
    often, junk = next(x for x in by.values() if len(x) == 2)
    df = spark.createDataFrame([(i, often) for i in range(30)] + [(99, junk)], "doc_id long, text string")
    m = lmscore.fit(df)
    ask = spark.createDataFrame([(0, often), (1, junk), (2, f"{often} {junk}"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.score(ask, m).collect()}
    assert abs(got[0].log_likelihood - got[1].log_likelihood - math.log(30)) < 1e-6
    assert got[2].n_words == 2 and got[3].log_likelihood == 0 and got[0].text == often
    alone = lmscore.log_probabilities(m, *next(lmscore.words_of(pa.array([often]))))[0]
    assert abs(np.exp(got[0].log_likelihood) + np.exp(got[1].log_likelihood) - np.exp(alone)) < 1e-6


def test_lm_descends_along_the_gradient(monkeypatch):
    """Against differences of the loss in every kind of weight."""
    monkeypatch.setattr(lmscore, "RATE", 1e-3)
    rng = np.random.default_rng(2)
    m = lmscore.start(rng.integers(0, 9, lmscore.BUCKETS), np.zeros(0, np.uint64), np.zeros(0, np.int64), "")
    for k in lmscore.WEIGHTS:
        setattr(m, k, (getattr(m, k) + rng.normal(0, 0.1, getattr(m, k).shape)).astype(np.float64))
    context, leaf = rng.integers(0, 9, (50, 4)).astype(np.int16), rng.integers(0, 100, 50)

    def loss():
        total = 0.0
        for c, t in zip(context, leaf, strict=True):
            h = np.tanh(sum(m.embed[n] @ m.mix[k] for k, n in enumerate(c)) + m.hidden)
            z, y = h @ m.out + m.bias, h @ m.low[t // lmscore.LEAVES] + m.low_bias[t // lmscore.LEAVES]
            total -= z[t // lmscore.LEAVES] - np.log(np.exp(z).sum()) + y[t % lmscore.LEAVES] - np.log(np.exp(y).sum())
        return total

    before = {k: getattr(m, k).copy() for k in lmscore.WEIGHTS}
    places = {k: [tuple(rng.integers(0, min(9, n)) if k == "embed" and i == 0 else rng.integers(0, n if k != "low" and k != "low_bias" or i else 4) for i, n in enumerate(before[k].shape)) for _ in range(4)] for k in before}
    want = {}
    for k, at in places.items():
        for x in at:
            getattr(m, k)[x] += 1e-5
            up = loss()
            getattr(m, k)[x] -= 2e-5
            want[k, x] = (up - loss()) / 2e-5
            getattr(m, k)[x] += 1e-5
    lmscore.descend(m, context, leaf)
    for (k, x), g in want.items():
        assert abs((before[k][x] - getattr(m, k)[x]) / 1e-3 - g) < 1e-3 * max(1, abs(g)), (k, x)


def test_equal_texts_score_alike_wherever_they_stand(spark):
    r = np.random.default_rng(3)
    one = " ".join(f"w{k}" for k in r.integers(0, 50, 300))
    rows = [(i, one if i % 3 == 0 else " ".join(f"w{k}" for k in r.integers(0, 50, int(r.integers(1, 400))))) for i in range(300)]
    got = lmscore.digest(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id % 3 = 0")
    assert got.select("log_likelihood").distinct().count() == 1


def test_every_word_trains_once():
    rows = np.array([0, 5, 5, 6, 38, 41])
    for rounds in (1, lmscore.ROUNDS, 3):
        parts = [lmscore.chosen(rows, turn, rounds) for turn in range(rounds)]
        assert sorted(np.concatenate(parts)) == list(range(41))


def test_lm_trains_on_words_at_any_place(spark, monkeypatch):
    seen, descend = [], lmscore.descend
    monkeypatch.setattr(lmscore, "descend", lambda m, c, t: seen.append(len(t)) or descend(m, c, t))
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", _local(spark))
    lmscore.fit(spark.createDataFrame([(i, "a b c d e f g " * 5) for i in range(30)], "doc_id long, text string"))
    assert sum(seen) == 30 * 35


def _local(spark):
    """mapInArrow in this process, so that a patched module counts what it does."""

    def run(df, f, schema):
        import pyarrow as pa

        return spark.createDataFrame(pa.Table.from_batches(list(f(iter(df.toArrow().to_batches())))))

    return run


# --- tool calls


def test_tool_calls_linked_ordered_and_validated(spark):
    C = "conv_id long, call_id string, position long, name string, arguments string, needs array<string>"
    calls = [
        (1, "a", 0, "search", '{"limit": 3.0, "query": "é"}', []), (1, "b", 1, "search", '{"query": "x", "limit": 99}', ["a"]), (1, "c", 2, "note", '{"query": "y"}', ["b", "a", "gone"]),
        (1, "a", 5, "note", '{"query": "again"}', []), (1, "p", 6, "note", '{"query": "z"}', ["q"]), (1, "q", 7, "note", '{"query": "z"}', ["p"]), (1, "r", 8, "note", '{"query": "z"}', ["q"]),
        (2, "a", 0, "other", "{}", None), (2, "m", 1, "note", "{oops", []), (2, "n", 2, "note", None, []), (2, None, 3, "note", '{"query": "z"}', []), (2, "u", 4, "note", '{"query": "z"}', []), (2, "u", 4, "note", '{"query": "z"}', []),
    ]
    results = [(1, i, 10, f"r{i}") for i in ("a", "b", "c", "p", "q", "r")] + [(1, "a", 20, "late"), (2, "a", 1, "x"), (2, "m", 1, "x"), (2, "n", 1, "x"), (2, None, 1, "x"), (9, "zz", 1, "x")]
    got = toolcalls.link(spark.createDataFrame(calls, C), spark.createDataFrame(results, "conv_id long, call_id string, position long, content string"), toolcalls.SCHEMAS).collect()
    assert len(got) == len(calls)
    by = {(r.conv_id, r.call_id, r.position): r for r in got}
    assert [by[1, x, i].level for i, x in enumerate("abc")] == [0, 1, 2]
    assert [by[1, x, i].status for i, x in enumerate("abc")] == ["ok", "invalid", "ok"] and by[1, "b", 1].errors == ["$.limit: maximum"]
    assert by[1, "a", 5].status == "repeated" and all(by[1, x, i].status == "cycle" and by[1, x, i].level is None for x, i in (("p", 6), ("q", 7), ("r", 8)))
    assert by[2, "a", 0].errors == ["no schema for other"] and by[2, "m", 1].errors == ["$: malformed"] and by[2, "n", 2].errors == ["$: null arguments"]
    assert sorted(r.status for r in got if r.call_id == "u") == ["repeated", "unanswered"]
    assert by[1, "a", 0].json == '{"arguments":{"limit":3,"query":"é"},"id":"a","level":0,"missing":[],"name":"search","needs":[],"result":"ra"}'
    assert json.loads(by[1, "c", 2].json)["missing"] == ["gone"]


def test_hostile_arguments_are_malformed_and_end_no_job(spark):
    deep, huge = "[" * 100_000 + "]" * 100_000, '{"query": "x", "limit": ' + "9" * 400 + "}"
    texts = {"deep": deep, "huge": huge, "longer": "9" * 5_000, "lone": r'{"query": "\ud800"}', "key": r'{"\udfff": 1}', "nan": "NaN", "inf": "[1e999]", "pair": r'{"query": "\ud83d\ude00"}'}
    calls = [(1, i, k, "search" if i == "huge" else "note", t, []) for k, (i, t) in enumerate(texts.items())]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "nobody", 0, "x")], "conv_id long, call_id string, position long, content string")
    got = {r.call_id: r for r in toolcalls.link(df, results, toolcalls.SCHEMAS).collect()}
    assert got.keys() == texts.keys()
    assert all(got[i].errors == ["$: malformed"] for i in ("deep", "longer", "lone", "key", "nan", "inf"))
    assert got["huge"].errors == ["$.limit: maximum"] and got["pair"].errors == []


def test_levels_of_random_graphs_equal_a_plain_loop(spark):
    rng = np.random.default_rng(7)
    calls = []
    for conv in range(40):
        n = int(rng.integers(1, 12))
        for k in range(n):
            # Mostly earlier calls, some later or the call itself (cycles), some that aren't there, some twice.
            needs = [f"c{int(x)}" for x in rng.integers(0, n + 2 if rng.random() < 0.15 else max(k, 1), int(rng.integers(0, 3)))] if k or rng.random() < 0.2 else []
            calls.append((conv, f"c{k}", k, "note", '{"query": "x"}', needs))
    want = {}
    for conv in range(40):
        own = {c[1]: {x for x in c[5]} for c in calls if c[0] == conv}
        level: dict = {}
        while more := [i for i, needs in own.items() if i not in level and all(x in level for x in needs if x in own)]:
            level |= {i: 1 + max((level[x] for x in own[i] if x in own), default=-1) for i in more}
        want |= {(conv, i): (level.get(i), sorted(x for x in needs if x not in own)) for i, needs in own.items()}
    df = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, needs array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    got = {(r.conv_id, r.call_id): (r.level, json.loads(r.json)["missing"], r.status) for r in toolcalls.link(df, none, toolcalls.SCHEMAS).collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    assert any(v[0] is None for v in want.values()) and all((s == "cycle") == (level is None) for level, _, s in got.values())


def test_levels_write_one_small_checkpoint_a_round(spark):
    chain = [(1, f"c{i}", i, "note", '{"query": "x"}', [f"c{i - 1}", "gone"] if i else []) for i in range(6)] + [(2, "a", 0, "note", "{}", ["b"]), (2, "b", 1, "note", "{}", ["a"])]
    df = spark.createDataFrame(chain, "conv_id long, call_id string, position long, name string, arguments string, needs array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    shared_folder(spark)
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    before = len(list(folder.glob("rdd-*/part-*")))
    got = toolcalls.link(df, none, toolcalls.SCHEMAS).collect()
    assert [(r.conv_id, r.call_id, r.level, r.status == "cycle") for r in got] == [(1, f"c{i}", i, False) for i in range(6)] + [(2, "a", None, True), (2, "b", None, True)]
    assert [json.loads(r.json)["missing"] for r in got] == [[]] + [["gone"]] * 5 + [[]] * 2
    # The needs, and a file for each of five levels and for the cycle, which a last round tells.
    assert 1 <= len(list(folder.glob("rdd-*/part-*"))) - before <= 7


def test_tool_call_digest_orders_topologically(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(3) for t in range(40)] + [(7, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = toolcalls.digest(df).collect()
    assert len(got) == 61
    level = {(r.conv_id, r.position): r.level for r in got}
    for (c, t), n in level.items():
        if t:
            assert n == 1 + level[c, t // 4 * 2]
    assert toolcalls.digest(df.where("false")).count() == 0


def test_tiles_scale_by_the_largest_value(spark):
    ramp = (np.arange(64 * 64).reshape(64, 64) % 16).astype(np.uint8)
    raw = b"P5 64 64 %d\n"
    content = [raw % 65535 + (ramp.astype(">u2") * 4369).tobytes(), raw % 15 + ramp.tobytes(), raw % 255 + (ramp * 17).tobytes(), b"P2 64 64 15 " + b" ".join(b"%d" % v for v in ramp.reshape(-1).tolist())]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(content)], "k long, content binary")
    got: dict = {}
    for r in media.tiles(df).collect():
        assert r.error is None
        got.setdefault(r.k, {})[r.tile_y, r.tile_x] = (bytes(r.tile), r.dhash)
    assert len(got) == 4 and all(got[k] == got[2] for k in got)


# --- schemas and decoders that ended jobs


def test_schemas_of_several_types_and_booleans():
    v = toolcalls.violations
    assert v(None, {"type": ["string", "null"]}) == [] and v(1, {"type": ["string", "null"]}) == ["$: type string or null"]
    assert v({"a": 1, "b": 2}, {"properties": {"a": True, "b": False}}) == ["$.b: false"]
    assert v(True, {"enum": [1]}) == ["$: enum"] and v(1.0, {"enum": [1]}) == [] and v([1, {"a": 2}], {"enum": [[1, {"a": 2.0}]]}) == []
    assert v({"x": "y"}, {"additionalProperties": {"type": "integer"}}) == ["$.x: type integer"]
    assert v([1, "a"], {"items": True}) == [] and v([1], {"items": False}) == ["$[0]: false"] and v(3, True) == []


def test_calls_come_out_in_topological_order(spark):
    rows = [(c, f"c{i}", 10 - i, "f", "{}", [f"c{j}" for j in range(i)]) for c in (2, 1) for i in range(5)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, position long, name string, arguments string, needs array<string>")
    got = toolcalls.link(calls, spark.createDataFrame([], "conv_id long, call_id string, position long, content string"), {"f": {"type": ["object", "null"]}}).collect()
    assert [(r.conv_id, r.call_id, r.level) for r in got] == [(c, f"c{i}", i) for c in (1, 2) for i in range(5)]


def bmp(width, height, bits, pixels, masks=None):
    body = (b"".join(m.to_bytes(4, "little") for m in masks) if masks else b"") + pixels
    head = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + (1).to_bytes(2, "little") + bits.to_bytes(2, "little") + (3 if masks else 0).to_bytes(4, "little") + bytes(20)
    start = 14 + 40 + (12 if masks else 0)
    return b"BM" + (14 + len(head) + len(body)).to_bytes(4, "little") + bytes(4) + start.to_bytes(4, "little") + head + body


def test_bmp_bit_masks():
    image = media.decode_bmp(bmp(1, 1, 32, bytes([10, 20, 30, 0]), (0xFF, 0xFF00, 0xFF0000)))
    assert image.tolist() == [[[10, 20, 30]]]
    five_six_five = (31 << 11 | 21 << 5 | 0).to_bytes(2, "little") + bytes(2)
    assert media.decode_bmp(bmp(1, 1, 16, five_six_five, (0xF800, 0x7E0, 0x1F))).tolist() == [[[255, 85, 0]]]
    assert media.decode_bmp(bmp(1, 1, 16, (0x7C00).to_bytes(2, "little") + bytes(2))).tolist() == [[[255, 0, 0]]]
    with pytest.raises(ValueError):
        media.decode_bmp(bmp(1, 1, 32, b"", (1, 2, 4))[:60])


def test_media_that_can_t_be_read_end_no_job(spark):
    huge = b"P5\n%d %d\n255\n" % (10**9, 10**9)
    rows = [(0, b"P2\n1 1\n255\n" + b"1" * 23), (1, huge + b"x"), (2, b"P1\n99999999 99999999\n1"), (3, None), (4, b""), (5, bmp(1 << 20, 1 << 10, 24, b"x"))]
    got = media.tiles(spark.createDataFrame(rows, "k int, content binary")).collect()
    assert sorted(r.k for r in got) == list(range(6)) and all(r.error for r in got)


def test_long_images_are_summed_by_strips(monkeypatch):
    image = np.random.default_rng(0).integers(0, 256, (1003, 64)).astype(np.uint8)
    whole = media.area_resize(image, 16, 16)
    for strip in (1, 7, 64):
        monkeypatch.setattr(media, "STRIP", strip)
        assert (media.area_resize(image, 16, 16) == whole).all()


def test_the_difference_hash_by_hand():
    row = [0, 9, 3, 3, 8, 1, 2, 7, 5]  # rises, falls, level, rises, falls, rises, rises, falls
    image = np.tile(np.array(row, np.uint8), (8, 1))
    assert media.difference_hash(image) == int("10010110" * 8, 2)
    image[0] = row[::-1]
    assert f"{media.difference_hash(image):064b}"[:8] == "10010010"
