import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from steadyframes.llm import toxicity as t


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "re", "mi") for b in ("ton", "la", "ri", "su") for c in ("", "n", "da", "pel")]
    docs, labels = [], []
    for i in range(1500):
        lang = r.choice(["en", "de"])
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = r.random() < 0.25
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice({"en": ["idiot", "scum"], "de": ["lowei" + r.choice(["", "st", "ung"])]}[lang]))
        docs.append((i, " ".join(w), lang))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_decisions(spark, tables):
    docs, labels = tables
    got = t.digest(docs, labels).join(labels, "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert held.n > 300 and held.a > 0.95
    assert got.where("score < 0 or score > 1 or (predicted = 1) <> (score >= 0.7)").count() == 0
    assert got.where("held_out <> (crc32(cast(doc_id as string)) % 3 = 1)").count() == 0


def test_scores_see_only_the_text(spark, tables):
    docs, labels = tables
    m = t.fit(docs, labels)
    rows = [(1, "koton idiot", "en"), (2, "koton idiot", None), (3, None, "de"), (4, "", "en"), (5, "koton idiot", "de"), (6, "word " * 5000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in t.score(df, m).collect()}
    assert got[1].score == got[2].score == got[5].score and got[3].score == got[4].score
    assert got[2].threshold == m.thresholds[""] and all(r.toxic == (r.score >= r.threshold) for r in got.values())
    assert t.score(df.where("false"), m).count() == 0


def test_one_class_or_no_labels(spark, tables):
    docs, labels = tables
    for some in (labels.where("toxic = 0"), labels.where("false"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert t.digest(docs.limit(5), some).count() == 5


def by_loops(m, words):
    """The network's score of one list of words, a window and a filter at a time."""
    rows = []
    for w in words:
        parts, *_ = t.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
        rows.append(sum(m.table[b].astype(float) for b in parts[0]))
    z = m.bias
    for k, width in enumerate(t.WIDTHS):
        for j in range(t.FILTERS):
            best = max((sum(float(rows[i + s] @ m.filters[k][s][:, j]) for s in range(width) if i + s < len(rows)) for i in range(len(rows))), default=None)
            value = 0.0 if best is None else max(best + float(m.shifts[k][j]), 0.0)
            z += value * float(m.out[k * t.FILTERS + j])
    z = z * m.scale + m.offset
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_plain_loops(spark, tables):
    docs, labels = tables
    m = t.fit(docs, labels)
    r = random.Random(3)
    texts = ["", "idiot", "KOTON idiot", *(" ".join(r.choice(["koton", "rila", "idiot", "scum", "x", "baton"]) for _ in range(r.randint(1, 30))) for _ in range(25))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for row in t.score(df, m).collect():
        assert abs(row.score - by_loops(m, texts[row.doc_id].lower().split())) < 1e-4


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)]
    data = [[words[i] for i in rng.integers(0, 30, rng.integers(3, 9))] for _ in range(24)]
    y = np.array([int("w3" in d or "w7" in d) for d in data])
    parts = np.concatenate([t.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for d in data for w in d])
    rows = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    m = t.train(parts, rows, y)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))

    def loss(model):
        p = np.clip(t.scores(model, parts, np.arange(len(parts)), rows), 1e-6, 1 - 1e-6)
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    assert loss(m) < 0.9 * loss(t._start(parts, rows, y, np.random.default_rng(7)))


def test_thresholds_of_languages_are_columns(spark, tables):
    docs, labels = tables
    got = t.digest(docs, labels)
    m = t.fit(docs, labels)
    assert {(r.lang, r.threshold) for r in got.join(docs, "doc_id").select("lang", "threshold").distinct().collect()} == {(x, m.thresholds.get(x, m.thresholds[""])) for x in ("en", "de")}
    assert got.where("over_threshold <> (score >= threshold)").count() == 0


def test_all_labelled_rows_and_all_their_words_are_learnt_from(spark, monkeypatch):
    """More rows than any sample took, and long texts whose telling words stand at their ends."""
    r = random.Random(6)
    long = [" ".join(r.choice(["koton", "rila", "baton", "misu"]) for _ in range(2500)) for _ in range(60)]
    docs = [(i, f"word w{i}", "en") for i in range(10000)] + [(10000 + i, x + (" vilescum" if i % 2 else " kindly"), "en") for i, x in enumerate(long * 4)]
    labels = spark.createDataFrame([(i, int(text.endswith("vilescum"))) for i, text, _ in docs], "doc_id long, toxic int")
    got = []
    whole = t._from_counts
    monkeypatch.setattr(t, "_from_counts", lambda seen, bad, good, rng: got.append((seen, bad, good)) or whole(seen, bad, good, rng))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    m = t.fit(frame, labels)
    seen, bad, good = got[0]
    learnt = labels.where("crc32(cast(doc_id as string)) % 3 <> 1").where("pmod(xxhash64(doc_id), 3) <> 2")
    assert (bad, good) == (learnt.where("toxic = 1").count(), learnt.where("toxic = 0").count()) and good > 4000
    parts, *_ = t.word_hashes(np.frombuffer(b"word", np.uint8), np.array([0, 4]))
    assert seen[1][parts[0][0]] >= learnt.where("doc_id < 10000").count()
    held = t.score(frame, m).where("doc_id >= 10000 and crc32(cast(doc_id as string)) % 3 = 1").select((F.col("score") >= 0.7).alias("found"), F.col("text").endswith("vilescum").alias("bad")).collect()
    assert len(held) > 50 and sum(x.found == x.bad for x in held) > 0.95 * len(held)


def test_the_driver_keeps_no_rounds_table(spark, tables, monkeypatch):
    docs, labels = tables
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(broadcast(self, value)) or sent[-1])
    t.fit(docs, labels)
    assert len(sent) == t.EPOCHS + 1 and not [b for b in sent if os.path.exists(b._path)]  # destroyed, not only unpersisted


def test_means_of_changes_come_in_the_tables_precision():
    rng = np.random.default_rng(5)
    size, n = t.BUCKETS // t.PACKS, [3.0, 4.0]
    at = [np.array([0, 7, size - 1], np.int32), np.array([7, 9], np.int32)]
    change = [rng.normal(size=(len(x), t.DIM)).astype(np.float32) for x in at]
    flat = [rng.normal(size=5), rng.normal(size=5)]
    rows = [(2, k, at[k].tobytes(), change[k].tobytes(), n[k]) for k in (0, 1)] + [(t.PACKS, k, b"", flat[k].tobytes(), n[k]) for k in (0, 1)]
    batch = pa.table(list(zip(*rows, strict=True)), names=["pack", "task", "at", "change", "n"]).to_batches()
    got = {b.column("pack")[0].as_py(): b.column("mean")[0].as_py() for b in t._averaged(batch, 7)}
    want = np.zeros((size, t.DIM))
    for x, c, k in zip(at, change, n, strict=True):
        want[x] += c * k
    assert len(got[2]) == 4 * want.size and np.array_equal(np.frombuffer(got[2], np.float32).reshape(want.shape), (want / 7).astype(np.float32))
    assert np.array_equal(np.frombuffer(got[t.PACKS]), (flat[0] * 3 + flat[1] * 4) / 7)
