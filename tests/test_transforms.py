"""Properties of the transform algebra over tables, and fixed cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from steadyframes.functions import transforms as T
from steadyframes.operators import kernels as K

FIXED = [(0.0, 0.0, 0.0, 0.0), (0.1, 0.0, 10.0, 20.0), (0.0, 0.1, 5.0, -5.0), (0.05, 0.05, 100.0, 50.0)]
POINTS = [(0.0, 0.0), (100.0, 100.0), (50.0, 200.0), (-10.0, 30.0), (1.3, -2.7)]


def many(seed, n=50):
    r = random.Random(seed)
    return [(r.uniform(-0.3, 0.3), r.uniform(-0.2, 0.2), r.uniform(-50, 50), r.uniform(-50, 50)) for _ in range(n)]


def struct(p):
    return T.transform(*[F.col(f"{p}{k}") for k in "abxy"])


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(*s, *t, *u, *p) for s, t, u in zip(many(1), many(2), many(3), strict=True) for p in [(r.uniform(-100, 100), r.uniform(-100, 100)) for r in [random.Random(9)] for _ in range(5)]]
    rows += [(*s, *t, *t, *p) for s in FIXED for t in FIXED for p in POINTS]
    return spark.createDataFrame(rows, ", ".join(f"{p}{k} double" for p in "stu" for k in "abxy") + ", px double, py double")


def far(df, p, q):
    return df.select(F.max(T.p_distance(p, q))).first()[0]


def at(t, p="px", q="py"):
    return T.t_warp(t, F.col(p) if isinstance(p, str) else p, F.col(q) if isinstance(q, str) else q)


def test_inverse_takes_points_back(pairs):
    df = pairs.withColumn("w", at(struct("s")))
    assert far(df, at(T.t_inverse(struct("s")), F.col("w.x"), F.col("w.y")), T.point("px", "py")) < 1e-9
    both = T.t_compose(struct("s"), T.t_inverse(struct("s")))
    assert df.select(F.max(F.greatest(*[F.abs(both[c]) for c in ("A", "B", "TX", "TY")]))).first()[0] < 1e-12


def test_compose_is_one_after_the_other_and_associative(pairs):
    df = pairs.withColumn("w", at(struct("s")))
    assert far(df, at(T.t_compose(struct("s"), struct("t"))), at(struct("t"), F.col("w.x"), F.col("w.y"))) < 1e-9
    left = T.t_compose(T.t_compose(struct("s"), struct("t")), struct("u"))
    assert far(df, at(left), at(T.t_compose(struct("s"), T.t_compose(struct("t"), struct("u"))))) < 1e-9


def test_known_composition(spark):
    t = spark.range(1).select(T.t_compose(T.transform(0.1, 0.0, 10.0, 20.0), T.transform(0.0, 0.1, 5.0, 5.0)).alias("t")).first().t
    assert [round(v, 9) for v in t] == [0.1, 0.11, 13.0, 26.0]


def test_columns_equal_the_kernels(pairs):
    for r in pairs.select("*", T.t_compose(struct("s"), struct("t")).alias("c"), T.t_inverse(struct("s")).alias("i")).limit(60).collect():
        s, t = (r.sa, r.sb, r.sx, r.sy), (r.ta, r.tb, r.tx, r.ty)
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(r.c, K.compose(s, t), strict=True))
        assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(r.i, K.inverse(s), strict=True))


def test_singular_and_null(spark):
    r = spark.range(1).select(T.t_inverse(T.transform(-1.0, 0.0, 1.0, 1.0)).alias("a"), T.t_inverse(T.transform(F.lit(None), 0.0, 1.0, 1.0)).alias("b")).first()
    assert r.a.A is None and r.b.A is None


def test_lanczos_weight_is_near_the_sinc_form(spark):
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    rows = spark.range(-20000, 20001, 7).select((F.col("id") / 10000.0).alias("x")).withColumn("w", T.lanczos2("x")).collect()
    error = [abs(r.w - (sinc(r.x) * sinc(r.x / 2) if abs(r.x) < 2 else 0.0)) for r in rows]
    assert max(error) < 4e-4 and sum(error) / len(error) < 1.2e-4
    assert spark.range(1).select(T.lanczos2(F.lit(2.0))).first()[0] == 0.0


def test_decay(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (48.0,), (56.0,), (64.0,), (65.0,)], "d double").select(T.decay_factor("d", 48.0, 64.0, 0.9, 0.7)).collect()]
    assert [round(g, 9) for g in got] == [0.9, 0.9, 0.8, 0.7, 0.7]
