"""Column functions against plain Python."""

import math
import unicodedata

from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import plausible as P
from plumbline.functions import text as X


def test_six_digits(spark):
    values = [0.0, 1.0, -2.5, 1234567.0, 999999.5, 0.0001, 0.00001234, 3.14159265, -0.5, 100000.0, 1e20, 12.3456789]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.six_digits(F.col("v")).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {v: f"{v:g}" for v in values}


def _plausible(text):
    if text is None or len(text) > 512:
        return False
    control = lambda c: unicodedata.category(c)[0] == "C" and c not in "\n\r\t"

    def counts(c):
        if c == "\ufffd" or "\ue000" <= c <= "\uf8ff":
            return -6
        if control(c):
            return -5
        if c.isascii():
            return 2 if c.isalnum() else 1
        if any(a <= c <= b for a, b in ("\u3000\u30ff", "\u3400\u4dbf", "\u4e00\u9fff", "\uff01\uff60", "\uffe0\uffe6")):
            return 2
        return 1 if c.isalpha() or c.isnumeric() or c.isspace() else -2

    return text == "" or sum(map(control, text)) < 4 and sum(map(counts, text)) >= -(len(text) // 2)


def test_plausible_text(spark):
    texts = [None, "", "plain", "\x00\x01\x02", "\x00\x01\x02\x03" + "a" * 99, "\ufffd\ufffd", "\ufffd" + "a" * 3, "\ue000" * 3 + "a" * 9, "\u56f3\u9762", "a" * 512, "a" * 513, "\u2603\u2603", "\u2603 a", "\u00e9\u00fc\u00df\u00b2", "\U0001f600", "\t\n", "\u200b\u200b", "\uff0a\u3000x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", P.plausible_text(F.col("t")).alias("ok"))
    assert {r.i: r.ok for r in df.collect()} == {i: _plausible(t) for i, t in enumerate(texts)}


def test_bulged_path(spark):
    """Two half circles of radius 1 about (1, 0), closed: every point is on the circle, and both ends are the first point."""
    df = spark.createDataFrame([(0, [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0)]), (1, [(3.0, 4.0, 1.0)]), (2, [])], "i int, p array<struct<x:double,y:double,bulge:double>>")
    got = {r.i: r.q for r in df.select("i", G.bulged_path(F.col("p"), F.lit(True)).alias("q")).collect()}
    assert len(got[0]) == 65 and got[1] == [(3.0, 4.0)] and got[2] == []
    assert all(math.isclose(math.hypot(x - 1, y), 1, abs_tol=1e-9) for x, y in got[0])
    assert got[0][0] == got[0][-1] == (0.0, 0.0) and got[0][32] == (2.0, 0.0)


def test_odd_values(spark):
    """Nulls, NaN and empty arrays give a defined value."""
    nan = float("nan")
    df = spark.createDataFrame([(None, None, None), (nan, 1.0, []), (0.0, 0.0, [(nan, nan)])], "x double, r double, p array<struct<x:double,y:double>>")
    rows = df.select(P.tiny_arc(F.col("x"), F.lit(0.0), F.col("r")).alias("a"), P.far_from_origin(F.col("p")).alias("f"), P.within(F.col("x")).alias("w"), G.angle_unit(F.array("x")).alias("u"), G.unit(F.col("x"), F.col("r")).alias("d")).collect()
    assert [(r.a, r.f, r.w, r.u, r.d) for r in rows] == [(False, False, False, "rad", None), (False, False, False, "rad", None), (True, False, True, "rad", None)]
