import math

import pytest
from pyspark.sql import functions as F

from quarryline.functions import geometry as G


def arcs(spark, *rows):
    df = spark.createDataFrame([(k, *map(float, r[:5]), r[5]) for k, r in enumerate(rows)], "k int, x1 double, y1 double, x2 double, y2 double, curve double, m boolean")
    got = df.select("k", G.arc_bounds(*(F.col(c) for c in ("x1", "y1", "x2", "y2", "curve", "m"))).alias("b")).orderBy("k").collect()
    return [r.b and tuple(r.b) for r in got]


def test_semicircles_and_major_arcs(spark):
    big = math.sqrt(200)
    got = arcs(spark, *((0, 0, 20, 0, c, False) for c in (180, -180, 270, -270, 0, 0.0005)))
    want = [(0, 0, 20, 10), (0, -10, 20, 0), (10 - big, 0, 10 + big, 10 + big), (10 - big, -10 - big, 10 + big, 0), (0, 0, 20, 0), (0, 0, 20, 0)]
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w)


def test_bounds_hold_samples_of_the_arc_and_touch_them(spark):
    rows, samples = [], []
    for curve in (30, 100, 180, 250, 330, -30, -100, -200, -359):
        for start in (0, 37, 90, 200, 310):
            # A circle of radius 5 around (3, 7), walked from an angle by the curve; y runs down, so a positive curve turns back.
            at = [math.radians(start - curve * k / 4000) for k in range(4001)]
            points = [(3 + 5 * math.cos(a), 7 + 5 * math.sin(a)) for a in at]
            for mirrored in (False, True):
                rows.append((*points[0], *points[-1], -curve if mirrored else curve, mirrored))
                samples.append(points)
    for got, points in zip(arcs(spark, *rows), samples, strict=True):
        xs, ys = zip(*points, strict=True)
        assert got == pytest.approx((min(xs), min(ys), max(xs), max(ys)), abs=1e-5)


def test_no_arcs(spark):
    assert arcs(spark, *((0, 0, 20, 0, c, False) for c in (360, -360, float("inf"), float("nan"), 400)), (1, 1, 1, 1, 90, False)) == [None] * 6


def texts(spark, *rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, t string, angle double, m boolean, align string")
    got = df.select("k", G.text_bounds(F.col("t"), F.lit(10.0), F.lit(20.0), F.lit(2.0), F.col("angle"), F.col("m"), F.col("align")).alias("b")).orderBy("k").collect()
    return [r.b and tuple(round(v, 6) for v in r.b) for r in got]


def test_text_bounds(spark):
    assert texts(spark, ("abc", 0.0, False, "bottom-left"), ("abc", 0.0, True, "bottom-left"), ("abc", 0.0, False, "center"), ("a\nabc\n", 0.0, False, "top-right"),
                 ("abc", 90.0, False, "bottom-left"), ("abc", 180.0, False, "bottom-left"), ("abc", 270.0, False, "bottom-left"), ("abc", -90.0, False, "bottom-left"),
                 ("", 0.0, False, "bottom-left"), ("abc", 0.0, False, "middle"), ("a\r\nbc", 360.0, False, "center-left")) == [
        (10, 17.4, 16, 20.2), (4, 17.4, 10, 20.2), (7, 18.6, 13, 21.4), (4, 19.8, 10, 25.1), (7.4, 14, 10.2, 20), (4, 19.8, 10, 22.6), (9.8, 20, 12.6, 26),
        (9.8, 20, 12.6, 26), (10, 17.4, 10, 20.2), None, (10, 17.35, 14, 22.65)]


def test_text_bounds_works_each_step_out_once(spark, capsys):
    from quarryline.plans import scans

    scans.text_extents(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("split(") == 1 and plan.count("COS(") == 1
