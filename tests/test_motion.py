"""Smoothing, accumulation and streams against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyframes.functions.params import StabParams
from steadyframes.operators import kernels as K
from steadyframes.operators import motion as M
from steadyframes.operators import scores
from steadyframes.streaming import online

SCHEMA = "video_id long, frame_idx long, width int, height int, A double, B double, TX double, TY double, ok boolean"


def rows(seed, counts=(30, 3, 1, 17), size=(1280, 720)):
    r = random.Random(seed)
    return [(v, i, *size, r.uniform(-0.01, 0.01), r.uniform(-0.01, 0.01), r.uniform(-9, 9), r.uniform(-9, 9), i > 0 and r.random() > 0.2) for v, n in enumerate(counts) for i in range(n)]


def smooth_one(data, lam, iterations):
    x = list(data)
    for _ in range(iterations):
        x = [0.5 * a + 0.5 * b for a, b in zip(x, data, strict=True)]
        for i in range(len(x) - 1):
            gap = x[i + 1] - x[i]
            if abs(gap) > lam:
                move = gap * (abs(gap) - lam) / abs(gap) / 2
                x[i], x[i + 1] = x[i] + move, x[i + 1] - move
            else:
                x[i] = x[i + 1] = (x[i] + x[i + 1]) / 2
    return x


def plain(video, p):
    """Frame after frame, as a player would: {frame: correction}."""
    out, acc = {}, K.IDENTITY
    motions = [r[4:8] for r in video]
    for n, r in enumerate(video):
        if not r[8]:
            acc = K.IDENTITY
        k, s = n - p.lag, K.IDENTITY
        j = n - p.memory
        if p.align_smoothed:
            j = k
        if j >= 0 and p.smooth:
            a = max(0, j - p.lag)
            window = motions[a : j + p.memory + 1]
            s = tuple(smooth_one([m[c] for m in window], p.lam, p.iterations)[j - a] for c in range(4))
        if k < 0:
            continue
        jitter = K.compose(motions[k], K.inverse(s)) if p.smooth else motions[k]
        acc = tuple(M.decay_scan(np.array([K.compose(acc, jitter)]), np.array([1280.0]), np.array([720.0]), p)[0])
        out[k] = K.inverse(acc)
    return out


@pytest.mark.parametrize("p", [StabParams(), StabParams(lag=3, memory=5, lam=1.0, iterations=10), StabParams(smooth=False, lag=1), StabParams(lag=4, memory=2, align_smoothed=True, iterations=7), StabParams(min_disp=2.0, max_disp=6.0, lag=2, memory=2)])
def test_stabilize_motion_equals_the_loop(spark, p):
    data = rows(4)
    got = {(r.video_id, r.frame_idx): (r.A, r.B, r.TX, r.TY) for r in M.stabilize_motion(spark.createDataFrame(data, SCHEMA).repartition(3), p).collect()}
    want = {(v, k): t for v in range(4) for k, t in plain([r for r in data if r[0] == v], p).items()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_smoothing_of_rows_equals_one_by_one():
    x = np.random.default_rng(1).normal(0, 5, (6, 9, 4))
    got = M.tv_smooth(x, 2.0, 25)
    assert np.allclose(got, [[list(c) for c in zip(*[smooth_one(x[i, :, k], 2.0, 25) for k in range(4)], strict=True)] for i in range(6)])


def test_segments_restart_where_the_size_changes(spark):
    data = [(1, i, w, 10, 0.0, 0.0, 0.0, 0.0, True) for i, w in enumerate((5, 5, 7, 7, 7, 5))]
    got = M.size_segments(spark.createDataFrame(data, SCHEMA)).orderBy("frame_idx").select("segment", "n").collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 0)]


def test_empty_table(spark):
    assert M.stabilize_motion(spark.createDataFrame([], SCHEMA)).count() == 0


def run_stream(spark, tmp_path, df, job):
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    before = spark.conf.get(online._STORE, None)
    with online.state_store(spark):
        run = job(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert spark.conf.get(online._STORE, None) == before
    run.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("job", ["smooth", "stabilize"])
def test_streams_equal_batches_in_any_order(spark, tmp_path, job):
    p = StabParams(lag=3, memory=2, iterations=5)
    df = spark.createDataFrame(rows(6, (14, 2, 9)), SCHEMA)
    if job == "smooth":
        out, want = run_stream(spark, tmp_path, df, lambda s: online.stream_smooth_motion(s, p)), M.smooth_motion(df, p.lag, p.memory, p.lam, p.iterations)
    else:
        out, want = run_stream(spark, tmp_path, df, lambda s: online.stream_stabilize_motion(s, p)), M.stabilize_motion(df, p)
    got, want = ({(r.video_id, r.frame_idx): [r.A, r.B, r.TX, r.TY] for r in x.collect()} for x in (out, want))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_late_and_repeated_rows():
    state = {"turn": 0}
    assert [r["frame_idx"] for r in online.in_order([{"frame_idx": 2}, {"frame_idx": 0}], state)] == [0]
    assert [r["frame_idx"] for r in online.in_order([{"frame_idx": 0}, {"frame_idx": 1}], state)] == [1, 2]
    assert state == {"turn": 3, "waiting": {}}


def test_gaps_close_when_many_wait_and_late_frames_are_dropped():
    state = {"turn": 0}
    frame = lambda k: {"frame_idx": k}
    assert online.in_order([frame(k) for k in (1, 2, 3)], state, ahead=3) == [] and len(state["waiting"]) == 3
    assert [r["frame_idx"] for r in online.in_order([frame(6)], state, ahead=3)] == [1, 2, 3] and state["lost"] == 1
    assert online.in_order([frame(0), frame(2)], state, ahead=3) == []  # late
    assert [r["frame_idx"] for r in online.in_order([], state, close=True)] == [6] and state == {"turn": 7, "waiting": {}, "lost": 3}
    assert online.in_order([], state, close=True) == []


def test_streams_with_lost_frames_equal_batches_over_the_rest(spark, tmp_path):
    """Frames that never come, and then so many that the gaps close."""
    data = [r for r in rows(7, (40, 12)) if r[1] not in (5, 6, 17, 39)]
    first, p = spark.createDataFrame(data, SCHEMA), StabParams(lag=3, memory=2, iterations=5)
    later = spark.createDataFrame([(v, 1000 + k, 1280, 720, 0.0, 0.0, 0.0, 0.0, False) for v in (0, 1) for k in range(60)], SCHEMA)
    for part in (first, later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    both = first.unionByName(later)
    for name, job, want in (("r1", online.stream_stabilize_motion, M.stabilize_motion(both, p)), ("r2", online.stream_smooth_motion, M.smooth_motion(both, p.lag, p.memory, p.lam, p.iterations))):
        source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with online.state_store(spark):
            run = job(source, p, online.GapParams(ahead=45)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start(str(tmp_path / name))
        run.awaitTermination()
        got, want = ({(r.video_id, r.frame_idx): [r.A, r.B, r.TX, r.TY] for r in x.collect()} for x in (spark.read.parquet(str(tmp_path / name)), want))
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in got)


def test_a_timer_closes_a_gap(spark, tmp_path):
    """Frame 3 never comes: the frames past it come out some time after."""
    import time

    data = [r for r in rows(9, (12,)) if r[1] != 3]
    df, p = spark.createDataFrame(data, SCHEMA), StabParams(lag=2, memory=1, iterations=3)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with online.state_store(spark):
        run = online.stream_stabilize_motion(source, p, online.GapParams(wait_ms=1500)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
    want = {r.frame_idx: r.TX for r in M.stabilize_motion(df, p).collect()}
    try:
        got, end = {}, time.time() + 90
        while len(got) < len(want) and time.time() < end and not run.exception():
            time.sleep(1)
            if (tmp_path / "out").exists():
                got = {r.frame_idx: r.TX for r in spark.read.schema("video_id long, frame_idx long, A double, B double, TX double, TY double").parquet(str(tmp_path / "out")).collect()}
    finally:
        run.stop()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_medians_grid_and_best(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert df.agg(scores.upper_median("v")).first()[0] == 3.0 and df.agg(scores.median_or_zero("v")).first()[0] == 2.5
    assert df.where("false").agg(scores.median_or_zero("v")).first()[0] == 0.0
    g = scores.param_grid(spark, (("a", "<", "b"),), a=[1, 5], b=[3, 9]).orderBy("combo_id").collect()
    assert [tuple(r) for r in g] == [(0, 1, 3), (1, 1, 9), (3, 5, 9)]
    s = spark.createDataFrame([(0, None), (1, float("nan")), (2, 0.5), (3, 0.5)], "combo_id long, ratio double")
    assert tuple(scores.best_combo(s).first()) == (2, 0.5) and scores.leaderboard(s, 9).count() == 2
    zero = scores.jitter_ratio(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "video_id long, frames long, out_jitter double"), spark.createDataFrame([(1, 0.0), (2, 1.0)], "video_id long, in_jitter double"))
    assert [r.ratio for r in zero.collect()] == [None]


def test_grid_smooths_once_for_each_setting(spark):
    from steadyframes.jobs import search

    df = spark.createDataFrame(rows(8, (12, 5)), SCHEMA)
    grid = search.smoother_grid(spark, {"lag": [2, 3], "memory": [1], "lam": [4.0], "min_disp": [4.0], "max_disp": [9.0, 12.0], "min_decay": [0.9], "max_decay": [0.5]})
    got = search.grid_corrections(df, grid)
    for c in grid.collect():
        p = StabParams(lag=c.lag, memory=c.memory, lam=c.lam, min_disp=c.min_disp, max_disp=c.max_disp, min_decay=c.min_decay, max_decay=c.max_decay)
        a, b = ({(r.video_id, r.frame_idx): (r.A, r.B, r.TX, r.TY) for r in x.collect()} for x in (got.where(F.col("combo_id") == c.combo_id), M.stabilize_motion(df, p)))
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_segments_together_equal_segments_alone(spark):
    rng = np.random.default_rng(1)
    sizes = [*rng.integers(1, 40, 60).tolist(), 300]
    begin = np.cumsum(sizes) - sizes
    n = int(sum(sizes))
    a, w, h = rng.normal(0, [0.01, 0.01, 9, 9], (n, 4)), np.full(n, 96.0), np.full(n, 64.0)
    limits, state = np.tile([16.0, 64.0, 0.95, 0.5], (n, 1)), rng.normal(0, 0.1, (len(sizes), 4))
    want = np.concatenate([M.decay_scan(a[b : b + s], w[b : b + s], h[b : b + s], limits[b : b + s], tuple(x)) for b, s, x in zip(begin, sizes, state, strict=True)])
    assert np.array_equal(M.scan_segments(a, w, h, limits, begin, state), want)


def test_a_segment_goes_on_in_the_next_batch(spark):
    rng = np.random.default_rng(2)
    rows = [(v, 0, i, 96, 64, tuple(rng.normal(0, [0.01, 0.01, 9, 9]).tolist())) for v in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "video_id long, reset long, frame_idx long, width int, height int, jitter struct<A:double,B:double,TX:double,TY:double>")
    p = StabParams()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.video_id, r.frame_idx): (r.A, r.B, r.TX, r.TY) for r in M.accumulate_motion(df, p).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for v in range(3):
        want = M.decay_scan(np.array([r[5] for r in rows if r[0] == v]), np.full(50, 96.0), np.full(50, 64.0), p)
        assert np.array_equal(np.array([got[v, i] for i in range(50)]), want)


@pytest.mark.parametrize("part", [1, 3, 7, 4096])
def test_numbers_on_two_levels_equal_those_of_one(spark, part):
    """Frame numbers with gaps, also before 0; sizes that change at and off the parts' borders."""
    r = random.Random(part)
    data = []
    for v in (0, 1, 2, None):
        at, w = -5, 7
        for _ in range(40 if v != 1 else 1):
            at, w = at + r.choice([1, 1, 1, 2, 9]), r.choice([w, w, w, 5, 7])
            data.append((v, at, w, 10, 0.0, 0.0, 0.0, 0.0, r.random() > 0.3))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = {(x.video_id, x.frame_idx): (x.segment, x.n) for x in M.size_segments(df, part).collect()}
    pairs = {(x.video_id, x.frame_idx): (x.key_idx, x.tmpl_idx, x.invert) for x in M.pair_frames(df, part).collect()}
    resets = {(x.video_id, x.frame_idx): x.reset for x in M.reset_segments(df, 4, part).collect()}
    numbers = {(x.video_id, x.frame_idx): (x.k, x.rows_) for x in M.number_rows(df, part=part).collect()}
    for v in (0, 1, 2, None):
        video = sorted((x for x in data if x[0] == v), key=lambda x: x[1])
        segment, n = 0, -1
        for k, x in enumerate(video):
            segment, n = (segment + 1, 0) if k and x[2] != video[k - 1][2] else (segment, n + 1)
            key = v, x[1]
            assert got[key] == (segment, n) and numbers[key] == (k, len(video))
            assert pairs.get(key) == (None if not n else (x[1], video[k - 1][1], False) if n % 2 else (video[k - 1][1], x[1], True))
            assert resets[key] == sum(not y[8] for y in video[: k + 5])


@pytest.mark.parametrize("part", [2, 5, 4096])
def test_chunks_smooth_as_whole_videos_do(spark, part):
    df = spark.createDataFrame([(x[0], x[1] * 2 + (x[1] > 9), *x[2:]) for x in rows(11, (45, 6, 1))], SCHEMA)
    key = lambda x: (x.video_id, x.frame_idx)
    for lag, memory in ((3, 2), (1, 5), (0, 0), (10, 5)):
        windows = M.motion_windows(df, lag, memory, part)
        whole = {key(x): x for x in M.smooth_windows(M.motion_windows(df, lag, memory), 2.0, 30).collect()}
        assert {key(x): x for x in M.smooth_windows(windows, 2.0, 30).collect()} == whole
        assert {key(x): x for x in M.smooth_motion(df, lag, memory, 2.0, 30, part).collect()} == whole
        for align in (False, True):
            p = StabParams(lag=lag, memory=memory, lam=2.0, iterations=30, align_smoothed=align)
            parts = M.attach_smoothed(M.reset_segments(df, lag, part), M.smooth_motion(df, lag, memory, 2.0, 30, part), lag, memory, align, part)
            fields = ("video_id", "frame_idx", "width", "height", *M.TRANSFORM, "reset", "smoothed")
            assert sorted(parts.select(*fields).collect()) == sorted(M.with_smoothed(df, p, part).select(*fields).collect())


def jitters(n, seed=0, videos=1):
    rng = np.random.default_rng(seed)
    return [(v, 0, i, 96, 64, *x) for v in range(videos) for i, x in enumerate(rng.normal(0, [0.01, 0.01, 9, 9], (n, 4)).tolist())]


def jitter_table(spark, data):
    df = spark.createDataFrame(data, "video_id long, reset long, frame_idx long, width int, height int, A double, B double, TX double, TY double")
    return df.select("video_id", "reset", "frame_idx", "width", "height", M.as_struct().alias("jitter"))


@pytest.mark.parametrize("batch", [10_000, 37])
def test_a_long_segment_scans_in_pieces_to_the_same_bits(spark, batch):
    data = jitters(5000, videos=2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        out, rounds = M.scan_in_rounds(jitter_table(spark, data), StabParams(), piece=512)
        got = {(r.video_id, r.frame_idx): (r.A, r.B, r.TX, r.TY) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(data) and rounds == 2
    for v in range(2):
        want = M.decay_scan(np.array([r[5:] for r in data if r[0] == v]), np.full(5000, 96.0), np.full(5000, 64.0), StabParams())
        assert np.array_equal(np.array([got[v, i] for i in range(5000)]), want)


def test_without_decay_rounds_go_on_until_no_bit_changes(spark):
    data = jitters(60)
    p = StabParams(min_decay=1.0, max_decay=1.0)
    out, rounds = M.scan_in_rounds(jitter_table(spark, data), p, piece=10)
    got = {r.frame_idx: (r.A, r.B, r.TX, r.TY) for r in out.collect()}
    want = M.decay_scan(np.array([r[5:] for r in data]), np.full(60, 96.0), np.full(60, 64.0), p)
    assert rounds == 7 and np.array_equal(np.array([got[i] for i in range(60)]), want)
    assert M.scan_in_rounds(jitter_table(spark, data), p)[1] == 0


def test_arrivals_of_many_videos_smooth_together_as_one_by_one():
    p, rng = StabParams(lag=3, memory=2, iterations=4), np.random.default_rng(11)
    held, size, first = np.array([0, 4, 6, 0]), np.array([5, 1, 7, 1]), np.array([0, 4, 20, 0])
    begin = np.cumsum(held + size) - (held + size)
    values = rng.uniform(-20, 20, (int((held + size).sum()), 4))
    at, got = online.smoothed_arrivals(values, begin, held, size, first, p)
    want = {}
    for b, h, n, f in zip(begin, held, size, first, strict=True):
        for j in range(n):
            place = min(f + j - p.memory, p.lag)
            if place >= 0:
                end = b + h + j
                want[end] = M.tv_smooth(values[None, end - p.memory - place : end + 1], p.lam, p.iterations)[0, place]
    assert sorted(want) == sorted(at.tolist()) and all((want[k] == x).all() for k, x in zip(at.tolist(), got, strict=True))


def test_smoothing_by_columns_and_bits_equals_the_plain_rule():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-100, 101, (300, 9, 2)) / 1e4, rng.integers(-1000, 1001, (300, 9, 2)) / 100], 2)
    x[7, 3, 0], x[8, 2, 2] = 9.0, 5.0 + x[8, 1, 2]
    for lam in (4.0, 0.01):
        want = x.copy()
        for _ in range(12):
            want = 0.5 * want + 0.5 * x
            for k in range(x.shape[1] - 1):
                a, b = want[:, k].copy(), want[:, k + 1].copy()
                size, middle = np.abs(b - a), (a + b) * 0.5
                move = (size - lam) / np.maximum(size, lam) * 0.5 * (b - a)
                want[:, k], want[:, k + 1] = np.where(size <= lam, middle, a + move), np.where(size <= lam, middle, b - move)
        assert (M.tv_smooth(x, lam, 12) == want).all()
    # Where no gap is wide the two kinds of sweep agree to the bit.
    calm = np.ascontiguousarray(x[:, :, 1:2].swapaxes(0, 1))
    assert (M._relax(calm, 4.0, 50, M._sweep_calm) == M._relax(calm, 4.0, 50, M._sweep)).all()
