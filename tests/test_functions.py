import hashlib
import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions import scalars, special
from scorewright.functions.hashing import draw, drawn


def test_draw_is_md5_of_seed_and_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string").select("k", "s", draw(7, F.col("k"), F.col("s")).alias("d")).collect()
    for r in rows:
        assert r.d == int(hashlib.md5(f"7-{r.k}-{r.s or ''}".encode()).hexdigest()[:8], 16)
    n = spark.range(20000).where(drawn(0.3, 1, F.col("id"))).count()
    assert abs(n - 6000) < 300


def test_clip_and_transforms_keep_null(spark):
    df = spark.createDataFrame([(None,), (-4.0,), (0.0,), (9.0,)], "x double")
    names = ["", "SQ_", "SR_", "LN_", "IV_", "EP_"]
    rows = df.select(scalars.clip(F.col("x"), -1, 5).alias("c"), *[scalars.transform(n, F.col("x")).alias("t" + n) for n in names]).collect()
    assert list(rows[0]) == [None] * 7
    assert [r.c for r in rows[1:]] == [-1.0, 0.0, 5.0]
    assert [r.tSR_ for r in rows[1:]] == [0.0, 0.0, 3.0]
    assert rows[2].tLN_ == pytest.approx(math.log(1e-5)) and rows[1].tIV_ == pytest.approx(-1e5) and rows[3].tEP_ == pytest.approx(-math.exp(-9))
    assert rows[1].tEP_ == pytest.approx(-1.0) and rows[3].tSQ_ == 81.0


def test_star_limits(spark):
    df = spark.createDataFrame([(110.0,), (109.9,), (100.0,), (90.1,), (90.0,), (None,)], "i double")
    assert [r[0] for r in df.select(scalars.star(F.col("i"))).collect()] == ["* (+)", "  (+)", "  (-)", "  (-)", "* (-)", "  (0)"]


def test_true_spellings(spark):
    df = spark.createDataFrame([(" Y ",), ("yes",), ("1",), ("n",), (None,)], "b string")
    assert [r[0] for r in df.select(scalars.is_true(F.col("b"), "string")).collect()] == [True, False, True, False, False]
    assert [r[0] for r in df.select(scalars.is_true(F.col("b"), "string", scalars.TRUE_PROFILE)).collect()] == [True, True, True, False, False]


def test_tails():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-12)
    assert special.t_upper(1.0, 1) == pytest.approx(0.25, abs=1e-12)
    assert special.t_upper(-1.0, 1) == pytest.approx(0.75, abs=1e-12)
    assert special.t_two_sided(1.96, 1e7) == pytest.approx(special.normal_two_sided(1.96), abs=1e-6)
    assert special.t_two_sided(40, 1000) < 1e-200 or special.t_two_sided(40, 1000) > 0
    assert special.chi2_upper(3.841458820694124) == pytest.approx(0.05, abs=1e-12)
    assert math.isnan(special.t_upper(1.0, 0))
