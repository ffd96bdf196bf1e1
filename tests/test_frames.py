"""Dense frames: equal to the long form, known motion found again, chunks without effect."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyframes.functions import transforms as T
from steadyframes.functions.params import AlignParams, StabParams
from steadyframes.jobs import align, catalog, jitter, search, stabilize
from steadyframes.operators import dense, pixels
from steadyframes.operators import kernels as K
from steadyframes.sources import fixtures, frames, texture
from steadyframes.streaming import online

RNG = np.random.default_rng(3)
IMAGE = RNG.integers(0, 256, (13, 18), dtype=np.uint8)
H, W = IMAGE.shape


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame([(1, 0, x, y, int(IMAGE[y, x])) for y in range(H) for x in range(W)], "video_id long, frame_idx long, x int, y int, v int")


def as_array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[value]
    return out


def test_long_form_equals_dense(spark, long):
    assert (as_array(pixels.pyr_down(long, W, H), "v", (H // 2, W // 2)) == K.half(IMAGE)).all()
    grads = pixels.grad_xy(long)
    gx, gy = K.gradients(IMAGE)
    assert (as_array(grads, "gx", (H, W)) == gx).all() and (as_array(grads, "gy", (H, W)) == gy).all()
    keys = pixels.tile_argmax(grads, 4, W, H)
    for axis, g in (("x", gx), ("y", gy)):
        at = K.strongest(g, 4)
        got = sorted((r.tile_y, r.tile_x, r.px, r.py) for r in keys.where(F.col("axis") == axis).collect())
        assert [(a, b) for _, _, a, b in got] == [tuple(p) for p in at.tolist()]
    t = (0.02, -0.03, 1.25, -0.5)
    warped = pixels.warp_gray(long, T.transform(*t), W, H)
    assert np.allclose(as_array(warped, "w", (H, W)), K.warp_gray(IMAGE, t))
    kp = pixels.sparse_jacobian(keys, W, H)
    diff = pixels.sparse_warp_diff(kp, long, long, T.transform(*t), W, H)
    pts = np.concatenate([K.strongest(gx, 4), K.strongest(gy, 4)])
    sample = dict(zip(map(tuple, pts.tolist()), K.lanczos_sample(IMAGE, *K.moved(pts, t, W, H)), strict=True))
    assert all(abs(r.sample - sample[r.px, r.py]) < 1e-9 for r in diff.collect())
    jac = np.concatenate([K.jacobians(K.strongest(g, 4), g, a) for a, g in (("x", gx), ("y", gy))])
    h = pixels.normal_matrix(kp).first()
    assert all(abs(h[f"h{a}{b}"] - (jac.T @ jac)[a, b]) < 1e-6 for a in range(4) for b in range(a, 4))


def test_sizes(spark):
    rows = spark.createDataFrame([(1280, 720), (96, 64), (640, 360), (20, 20), (40, 22)], "w int, h int").select("w", "h", pixels.pyramid_levels("w", "h").alias("n"), pixels.tile_size("w", "h").alias("t")).collect()
    for r in rows:
        assert r.n == len(K.pyramid(np.zeros((r.h, r.w), np.uint8))) and r.t == K.tile_size(r.w, r.h)
    assert [r.n for r in rows][:1] == [6] and rows[0].t == 20


@pytest.fixture(scope="module")
def clip(spark):
    rows = [(v, i, 1280, 720, 0.0, 0.0, float((v * 5 + i * 7) % 7 - 3), float((i * 3 + v) % 7 - 3), i > 0) for v in range(2) for i in range(9)]
    m = spark.createDataFrame(rows, "video_id long, frame_idx long, width int, height int, A double, B double, TX double, TY double, ok boolean")
    return fixtures.frames(m).persist()


def test_known_motion_is_found_whatever_the_chunks(spark, clip):
    whole = {(r.video_id, r.frame_idx): r for r in align.align_frames(clip).collect()}
    parts = {(r.video_id, r.frame_idx): r for r in align.align_frames(clip, chunk=2).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 18
    for r in clip.collect():
        a, b = whole[r.video_id, r.frame_idx], parts[r.video_id, r.frame_idx]
        assert np.allclose((a.A, a.B, a.TX, a.TY), (b.A, b.B, b.TX, b.TY))
        assert a.ok == (r.frame_idx > 0)
        assert abs(a.TX - r.dx) < 0.15 and abs(a.TY - r.dy) < 0.15


def test_flow_and_jitter(spark, clip):
    got = {(r.video_id, r.frame_idx): r.mag for r in jitter.flow_magnitude(clip, chunk=4).collect()}
    moves = {(r.video_id, r.frame_idx): float(np.hypot(r.dx, r.dy)) for r in clip.collect() if r.frame_idx}
    assert got.keys() == moves.keys() and all(abs(got[k] - moves[k]) < 0.05 for k in got)
    one = clip.where("frame_idx = 0")
    assert [(r.frames, r.jitter) for r in jitter.jitter(one).collect()] == [(1, 0.0)] * 2


def test_phase_correlation_on_noise():
    a = RNG.integers(0, 256, (64, 96), dtype=np.uint8)
    x, y, response = K.phase_shift(a, np.roll(a, (7, 5), (0, 1)))
    assert abs(x - 5) < 0.5 and abs(y - 7) < 0.5 and response > 0.5


def test_square_shift():
    a = np.zeros((64, 64), np.uint8)
    a[20:30, 20:30] = 255
    x, y, _ = K.phase_shift(a, np.roll(a, (7, 5), (0, 1)))
    assert abs(x - 5) < 0.5 and abs(y - 7) < 0.5


def test_phase_seed_fixed_or_not():
    y, x = np.mgrid[0:128, 0:192]
    big = lambda dx, dy: (127 + 60 * np.sin((x - dx) / 9.0) * np.cos((y - dy) / 11.0) + 40 * np.sin((x - dx + 2 * (y - dy)) / 17.0)).astype(np.uint8)
    a, b = K.pyramid(big(0, 0)), K.pyramid(big(2, 1))
    for fix in (False, True):
        t, ok, _ = K.align(K.Keyframe.of(b), a, AlignParams(phase_correlate=True, fix_phase_seed=fix))
        assert len(t) == 4 and isinstance(ok, bool)


def test_stabilizing_lowers_jitter_and_crops(spark, clip):
    p = StabParams(lag=2, memory=1, crop=4, smooth=False)
    out = stabilize.stabilize_frames(clip, p, chunk=4)
    assert {(r.width, r.height) for r in out.select("width", "height").collect()} == {(88, 56)}
    before, after = ({r.video_id: r.jitter for r in jitter.jitter(x).collect()} for x in (clip, out))
    assert all(after[v] < before[v] for v in before)


def test_warp_moves_content_and_fills_with_black():
    moved = K.warp_frame(IMAGE, (0.0, 0.0, 2.0, 1.0))
    assert (moved[1:, 2:] == IMAGE[:-1, :-2]).all() and not moved[0].any() and not moved[:, :2].any()


def test_dense_frames_of_colour(spark):
    a = RNG.integers(0, 256, (6, 8, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, 0, 8, 6, 3, bytearray(a.tobytes()))], "video_id long, frame_idx long, width int, height int, channels int, pixels binary")
    r = dense.to_gray(df).first()
    assert (np.frombuffer(r.pixels, np.uint8).reshape(6, 8) == K.gray(a)).all() and r.channels == 1
    r = dense.crop_frames(df, 1).first()
    assert (np.frombuffer(r.pixels, np.uint8).reshape(4, 6, 3) == a[1:-1, 1:-1]).all()
    n = np.frombuffer(dense.normalize_minmax(dense.to_gray(df)).first().pixels, np.uint8)
    assert n.min() == 0 and n.max() == 255
    assert [r.level for r in dense.build_pyramid(dense.to_gray(df), 2, 2).orderBy("level").collect()] == [0, 1]


def test_sources(spark, tmp_path, clip):
    (tmp_path / "v").mkdir()
    with pytest.raises(ValueError):
        frames.list_videos(spark, str(tmp_path / "v"))
    (tmp_path / "v" / "a.mp4").write_bytes(b"xyz")
    (tmp_path / "v" / "b.txt").write_bytes(b"x")
    assert [(r.path.rpartition("/")[2], r.length) for r in frames.list_videos(spark, str(tmp_path / "v")).collect()] == [("a.mp4", 3)]
    frames.write_frames(clip.drop("dx", "dy"), str(tmp_path / "f"))
    assert frames.read_frames(spark, str(tmp_path / "f")).count() == 18
    bad = clip.withColumn("pixels", F.when(F.col("frame_idx") == 0, F.col("pixels")))
    assert frames.usable(bad).count() == 2
    m = frames.output_meta(spark.createDataFrame([(0.0, 100, 80), (25.0, 100, 80)], "fps double, width int, height int"), 8).collect()
    assert [(r.fps, r.out_width, r.out_height) for r in m] == [(30.0, 84, 64), (25.0, 84, 64)]
    frames.write_jitter_report(spark.createDataFrame([("a", 1.5)], "video_id string, jitter double"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value == "a\tmedian_jitter_px=1.500000"


def test_streamed_alignment_equals_batch(spark, tmp_path, clip):
    df = clip.drop("dx", "dy").repartition(5)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    with online.state_store(spark):
        run = online.stream_align(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start(str(tmp_path / "out"))
    run.awaitTermination()
    got, want = ({(r.video_id, r.frame_idx): (r.A, r.B, r.TX, r.TY, r.ok) for r in x.collect()} for x in (spark.read.parquet(str(tmp_path / "out")), align.align_frames(clip)))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_streamed_frames_equal_batch_frames(spark, tmp_path, clip):
    df, p = clip.drop("dx", "dy").repartition(3), StabParams(lag=2, memory=1, crop=4, iterations=5)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sink = online.fixed_frames(lambda: spark.read.parquet(str(tmp_path / "in")), p, str(tmp_path / "out"))
    with online.state_store(spark):
        run = online.stream_stabilize_frames(source, p).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    run.awaitTermination()
    got, want = ({(r.video_id, r.frame_idx): (r.width, r.height, bytes(r.pixels)) for r in x.collect()} for x in (spark.read.schema(df.schema).parquet(str(tmp_path / "out")), stabilize.stabilize_frames(clip.drop("dx", "dy"), p)))
    assert len(got) and got == want


def test_shared_alignment_equals_one_by_one():
    y, x = np.mgrid[0:128, 0:192]
    big = lambda dx, dy: (127 + 60 * np.sin((x - dx) / 9.0) * np.cos((y - dy) / 11.0) + 40 * np.sin((x - dx + 2 * (y - dy)) / 17.0)).astype(np.uint8)
    lists, outcomes = {**search.ALIGN_GRID, "max_displacement": [0.3, 1.0, 6.0]}, set()
    for move in ((2, 1), (9, -5), (25, 17)):
        pair, shared = (K.Keyframe.of(K.pyramid(big(*move))), K.pyramid(big(0, 0)), True), {}
        for values in itertools.product(*lists.values()):
            p = AlignParams(**dict(zip(lists, values, strict=True)))
            got, want = search.aligned_once(pair, p, shared), align.align_pair(pair, p)
            assert tuple(map(float, got[0])) == tuple(map(float, want[0])) and got[1:] == want[1:]
            outcomes.add(got[1])
        assert len(shared) == 18
    assert outcomes == {True, False}


def test_warped_jitter_of_combos_equals_a_plain_loop(spark, clip):
    moves = {0: (0.0, 0.0, 0.0, 0.0), 1: (0.0, 0.0, 1.5, 0.0), 2: (0.001, 0.0, 0.0, -1.0), 3: (0.0, 0.0, 1.5, 0.0)}
    rows = clip.select("video_id", "frame_idx", "pixels").orderBy("video_id", "frame_idx").collect()
    # Combo 2 has no correction of frame 4, and combo 3 leaves combo 1 from frame 3 on.
    fix = lambda combo, k: None if combo == 2 and k == 4 else moves[0] if combo == 3 and k > 2 else tuple(v * (k % 3) for v in moves[combo])
    table = [(c, r.video_id, r.frame_idx, *fix(c, r.frame_idx)) for r in rows for c in moves if fix(c, r.frame_idx)]
    corrected = spark.createDataFrame(table, "combo_id long, video_id long, frame_idx long, A double, B double, TX double, TY double")
    want, counts = {}, {}
    for c in moves:
        last = None
        for r in rows:
            t = fix(c, r.frame_idx)
            now = K.warp_frame(np.frombuffer(r.pixels, np.uint8).reshape(64, 96), t)[4:-4, 4:-4] if t else None
            if now is not None:
                counts[c, r.video_id] = counts.get((c, r.video_id), 0) + 1
                if last is not None and r.frame_idx:
                    want.setdefault((c, r.video_id), []).append(K.flow_median(last, now))
            last = now
    for chunk, bucket in ((2, 32), (32, 32), (32, 1), (4, 2)):
        got = {(r.combo_id, r.video_id): (r.frames, r.out_jitter) for r in search.warped_jitter(clip.drop("dx", "dy"), corrected, 4, chunk, bucket).collect()}
        assert got.keys() == want.keys() == counts.keys()
        assert all(got[k][0] == counts[k] and abs(got[k][1] - np.median(want[k])) < 1e-9 for k in want)


def test_texture_has_the_same_bits_in_sql():
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-300, 300, (2, 200))
    got = duckdb.sql(f"SELECT {texture.texture_sql('u', 'v', 12)} AS t FROM (SELECT unnest({u.tolist()}) AS u, unnest({v.tolist()}) AS v)").fetchnumpy()["t"]
    assert (got == texture.texture(u, v, 12)).all()


def test_textured_frames_move_as_their_poses_say(spark):
    poses = spark.createDataFrame([(v, k, 0.002 * (k % 3 - 1), 0.001 * (k % 5 - 2), 1.5 * (k % 4), -1.0 * (k % 3)) for v in (0, 1) for k in range(40)], "video_id long, frame_idx long, A double, B double, TX double, TY double")
    f = texture.frames(poses, 192, 128, 12)
    assert {(r.video_id, r.channels, len(r.pixels)) for r in f.collect()} == {(0, 1, 192 * 128), (1, 3, 3 * 192 * 128)}
    true = {(r.video_id, r.frame_idx): r for r in texture.motion_of(poses).collect()}
    found = [{(r.video_id, r.frame_idx): (r.ok, r.A, r.B, r.TX, r.TY) for r in align.align_frames(f, chunk=c).collect()} for c in (32, 64)]
    assert found[0] == found[1]
    for k, (ok, a, b, x, y) in found[0].items():
        assert ok == (k[1] > 0) and max(abs(a - true[k].A), abs(b - true[k].B)) < 0.005 and max(abs(x - true[k].TX), abs(y - true[k].TY)) < 0.4


def test_mean_difference(spark):
    df = spark.createDataFrame([(1, bytearray([1, 5]), bytearray([3, 5])), (2, bytearray([1]), bytearray([1, 2]))], "k int, pixels binary, other binary")
    assert {r.k: r.difference for r in dense.mean_difference(df, "other").collect()} == {1: 1.0, 2: None}


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_of_frames_are_found_without_rendering(spark, clip):
    m = spark.createDataFrame([(1, k, 0.0, 0.0, 2.5, -1.0) for k in range(3)], "video_id long, frame_idx long, A double, B double, TX double, TY double")
    for f in (fixtures.frames(m), texture.frames(m, 192, 128, 12)):
        assert "pixels" in plan_of(f) and "ArrowEvalPython" in plan_of(f)
        assert "ArrowEvalPython" not in plan_of(dense.chunk_numbers(f))
    y, x = np.mgrid[0:64, 0:96]
    at = {}
    for r in clip.orderBy("video_id", "frame_idx").collect():
        sx, sy = (a + b for a, b in zip(at.get(r.video_id, (0, 0)), (r.dx, r.dy), strict=True))
        at[r.video_id] = sx, sy
        u, v = x - sx + 1000, y - sy + 1000
        want = np.minimum(255, 20 + np.abs(u % 46 - 23) * np.abs(v % 38 - 19) // 3 + np.abs((2 * u + v) % 122 - 61))
        assert (np.frombuffer(r.pixels, np.uint8).reshape(64, 96) == want).all()


def test_pixel_sums(spark):
    raw = [bytes([3]), bytes([0, 255, 7]), bytes(RNG.integers(0, 256, 192 * 128 * 3, dtype=np.uint8)), None]
    df = spark.createDataFrame([(k, bytearray(x) if x is not None else None) for k, x in enumerate(raw)], "k long, pixels binary")
    got = {r.k: (r.pixel_sum, r.placed_sum) for r in dense.pixel_sums(df).collect()}
    assert got == {k: (None, None) if x is None else (sum(x), sum(v * (i * 7919 % 10007) for i, v in enumerate(x))) for k, x in enumerate(raw)}


def test_whole_job_is_compared_under_its_own_corrections(spark, tmp_path):
    # In these videos corrections of the true motion and of what is found of it stand pixels apart at frame 3.
    spark.createDataFrame([(v * texture.FRAMES + k,) for v in (28, 78, 110) for k in range(8)], "vec_id long").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.QUERIES["c4_stabilize_similarity"](spark, str(tmp_path)).collect()
    assert len(got) == 15 and all(r.near for r in got)
