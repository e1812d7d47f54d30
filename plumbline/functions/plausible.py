"""Which primitives, texts and dimensions are plausible, as column expressions that are never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest coordinate, and the longest text with the number of control characters from which it is junk.
MOST, LONGEST, CONTROLS = 1e12, 512, 4
#: What a character of a text counts, by class; each character is in the first class that has it, others count -2.
PRIVATE = r"\uFFFD\uE000-\uF8FF"
WIDE = r"\u3000-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uFF01-\uFF60\uFFE0-\uFFE6"
CONTROL = r"\p{C}&&[^\n\r\t]"
LADDER = (
    (-6, f"[{PRIVATE}]"),
    (-5, rf"[{CONTROL}&&[^{PRIVATE}]]"),
    (2, "[A-Za-z0-9]"),
    (1, r"[\n\r\t -/:-@\[-`{-~]"),
    (2, f"[{WIDE}&&[^{PRIVATE}]&&[^\\p{{C}}]]"),
    (1, rf"[\p{{L}}\p{{N}}\p{{Z}}&&[^\x00-\x7F]&&[^{WIDE}]]"),
)


def sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def finite(value: Column) -> Column:
    """The value is there, and neither NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def within(*values: Column, most: float = MOST) -> Column:
    """All values are finite and at most ``most`` in size."""
    test = F.lit(True)
    for v in values:
        test = test & finite(v) & (F.abs(v) <= most)
    return sure(test)


def tiny_arc(x: Column, y: Column, radius: Column) -> Column:
    """An arc without size, or a very small one near the origin."""
    near = F.greatest(F.abs(x), F.abs(y)) <= 10
    return sure(finite(x) & finite(y) & finite(radius) & ((radius <= 1e-6) | (near & (radius <= 1e-3))))


def tiny_face(corners: Column) -> Column:
    """A face (array of x, y, z) whose finite coordinates are all about 0; one without finite coordinates isn't tiny."""
    sizes = F.filter(F.flatten(F.transform(corners, lambda p: F.array(*[F.abs(p[c]) for c in "xyz"]))), finite)
    return sure(F.array_max(sizes) <= 1e-6)


def far_from_origin(points: Column) -> Column:
    """A polyline of two to four points (array of x, y), at most three of them different, one at the origin and one far away."""
    flat = F.transform(F.filter(points, lambda p: finite(p["x"]) & finite(p["y"])), lambda p: F.struct(F.bround(p["x"], 6).alias("x"), F.bround(p["y"], 6).alias("y")))
    reach = lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"]))
    return sure(F.size(points).between(2, 4) & (F.size(F.array_distinct(flat)) <= 3) & F.exists(flat, lambda p: reach(p) <= 1.0) & F.exists(flat, lambda p: reach(p) >= 10000.0))


def implausible(dxftype: Column, x: Column, y: Column, radius: Column, points: Column, corners: Column) -> Column:
    """The test of an entity's type; other types are plausible."""
    return sure(F.when(dxftype == "ARC", tiny_arc(x, y, radius)).when(dxftype == "3DFACE", tiny_face(corners)).when(dxftype == "LWPOLYLINE", far_from_origin(points)))


def _number(text: Column, letters: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, letters, ""))


def text_score(text: Column) -> Column:
    """The sum of what a text's characters count by ``LADDER``."""
    known = F.array(*[_number(text, letters) for _, letters in LADDER])
    weights = F.array(*[F.lit(w + 2) for w, _ in LADDER])
    return F.aggregate(F.zip_with(known, weights, lambda n, w: n * w), -2 * F.length(text), lambda a, b: a + b)


def plausible_text(text: Column) -> Column:
    """At most ``LONGEST`` characters, fewer than ``CONTROLS`` control characters, and no less than minus half a point a character; an empty text is plausible, a null isn't."""
    n = F.length(text)
    test = F.when(n == 0, F.lit(True)).when(n > LONGEST, F.lit(False)).when(_number(text, f"[{CONTROL}]") >= CONTROLS, F.lit(False))
    return sure(test.otherwise(text_score(text) >= -F.floor(n / 2)))


def placeholder_dimension(points: list[Column], insert: Column, text: Column, measurement: Column) -> Column:
    """A dimension nobody filled in: all ``points`` (x, y, z) at the origin or null, so the insert, no text of its own and no measurement."""
    zero = lambda p: F.coalesce(p["x"], F.lit(0.0)).eqNullSafe(0.0) & F.coalesce(p["y"], F.lit(0.0)).eqNullSafe(0.0) & F.coalesce(p["z"], F.lit(0.0)).eqNullSafe(0.0)
    test = F.trim(F.coalesce(text, F.lit(""))).isin("", "<>") & measurement.isNull()
    for p in (*points, insert):
        test = test & zero(p)
    return sure(test)
