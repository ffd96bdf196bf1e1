"""Each stage of the pipeline on its own input, against a plain version; and all of it by run()."""

import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as c
from steadyframes.llm import bpe

from .test_decontaminate import brute as hits
from .test_jaccard import brute as near
from .test_pii import base

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in c.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "byte-level BPE"]
    kept = c.toxic(spark, docs, SF).cache()
    assert kept.columns == columns and set(rows(kept)) <= set(rows(docs)) and kept.count() > 0.8 * docs.count()

    first = c.near_duplicates(spark, kept, SF).cache()
    before = rows(kept)
    want = {i for i, _, component in near(before, 5, 80) if i == component}
    assert first.columns == columns and rows(first) == [r for r in before if r[0] in want]

    clean = c.benchmark(spark, first, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    by_id = dict(rows(first))
    found = {i: (n, hit) for i, n, hit, *_ in hits(list(by_id.items()), items)}
    assert clean.columns == columns
    got = dict(rows(clean))
    assert got.keys() == {i for i, (n, hit) in found.items() if hit <= 0.5 * n}
    for i, t in got.items():
        n, hit = found[i]
        assert (t == by_id[i]) == (hit == 0)

    private = c.personal_data(spark, clean, SF).cache()
    assert private.columns == columns
    for (i, a), (j, b) in zip(rows(clean), rows(private), strict=True):
        assert i == j and not base(b) or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", b)
        assert base(a) or a == b or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", b)

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = dict(rows(private))
    for r in c.token_ids(spark, private, SF).collect():
        assert r.token_ids == own.encode_ordinary(texts[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert c.run(spark, SF).count() == len(texts)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in c.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").limit(30).collect()
    some = [(r.doc_id, r.text, r.lang, r.source) for r in own]
    odd = [(None, "a text without an id", None, None), (None, None, "en", "s"), (9001, None, None, None), (9002, "", "en", "s"), (9003, "one", "xx", None), (9004, "word " * 30000, "en", "s")]
    rows_ = [(*r, 0.5, True, "x", 3, [1], i) for i, r in enumerate([*some, *odd, some[0], some[0], odd[4]])]
    extra = "score double, toxic boolean, threshold string, n_hit int, token_ids array<int>, tie int"
    docs = spark.createDataFrame(rows_, f"doc_id long, text string, lang string, source string, {extra}").repartition(3)
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema.names == docs.schema.names, name
        kept = got.collect()
        assert {None, 9001, 9002} <= {r.doc_id for r in kept}, name
        assert all(r.text is None for r in kept if r.doc_id == 9001), name
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id == 9003 for r in kept) == 1 and len(kept) == len({(r.doc_id, r.text) for r in kept})
            # Of repeated rows the one whose other columns come first stays: the first made.
            assert [r.tie for r in kept if r.doc_id == 9003] == [34]
    out = {r.doc_id: r for r in c.token_ids(spark, docs, SF).collect()}
    assert out[9001].n_tokens == out[9002].n_tokens == 0 and out[9003].n_tokens == 1
