"""Drawing files in the text exchange format as DataFrames, and back.

A file is lines in pairs of a group code and a value. Files are read whole (one
row a file), cut into pairs and these into records in their row, all with SQL
functions; nothing is parsed on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Group codes of the fields that entities are read into.
NUMBERS = {"10": "x", "20": "y", "30": "z", "11": "x2", "21": "y2", "31": "z2", "40": "r", "50": "start", "51": "end", "210": "ex", "220": "ey", "230": "ez"}
#: The fields of each type by their group code: d double, i whole number, s text, p point (of the code, and 10 and 20 more), * all of them.
FIELDS = {
    "LINE": {"start": "p10", "end": "p11", "thickness": "d39", "extrusion": "p210"},
    "POINT": {"location": "p10", "x_axis_angle": "d50"},
    "RAY": {"start": "p10", "direction": "p11"},
    "XLINE": {"start": "p10", "direction": "p11"},
    "CIRCLE": {"center": "p10", "radius": "d40"},
    "ARC": {"center": "p10", "radius": "d40", "start_angle": "d50", "end_angle": "d51"},
    "ELLIPSE": {"center": "p10", "major_axis": "p11", "extrusion": "p210", "ratio": "d40", "start_angle": "d41", "end_angle": "d42"},
    "SPLINE": {"flags": "i70", "degree": "i71", "knot_tolerance": "d42", "control_tolerance": "d43", "fit_tolerance": "d44", "knots": "d40*", "control_points": "p10*", "weights": "d41*", "fit_points": "p11*"},
    "LWPOLYLINE": {"flags": "i70", "elevation": "d38", "const_width": "d43"},
    "POLYLINE": {"flags": "i70", "elevation": "d30", "start_width": "d40", "end_width": "d41", "m_count": "i71", "n_count": "i72", "curve": "i75"},
    "VERTEX": {"location": "p10", "flags": "i70", "start_width": "d40", "end_width": "d41", "bulge": "d42", "tangent": "d50", "i1": "i71", "i2": "i72", "i3": "i73", "i4": "i74"},
    "TEXT": {"insert": "p10", "align": "p11", "height": "d40", "text": "s1", "rotation": "d50", "width_factor": "d41", "oblique": "d51", "style": "s7", "generation": "i71", "halign": "i72", "valign": "i73"},
    "ATTRIB": {"insert": "p10", "align": "p11", "height": "d40", "text": "s1", "rotation": "d50", "width_factor": "d41", "style": "s7", "tag": "s2", "flags": "i70"},
    "ATTDEF": {"insert": "p10", "align": "p11", "height": "d40", "text": "s1", "rotation": "d50", "width_factor": "d41", "style": "s7", "tag": "s2", "prompt": "s3", "flags": "i70"},
    "MTEXT": {"insert": "p10", "direction": "p11", "height": "d40", "width": "d41", "attachment": "i71", "flow": "i72", "rotation": "d50", "style": "s7", "text": "s1"},
    "INSERT": {"insert": "p10", "name": "s2", "sx": "d41", "sy": "d42", "sz": "d43", "rotation": "d50", "n_columns": "i70", "n_rows": "i71", "column_spacing": "d44", "row_spacing": "d45"},
    "DIMENSION": {"flags": "i70", "block": "s2", "style": "s3", "text": "s1", "measurement": "d42", "rotation": "d50", "definition": "p10", "text_at": "p11", "p13": "p13", "p14": "p14", "p15": "p15", "p16": "p16"},
    "LEADER": {"style": "s3", "arrow": "i71", "path": "i72", "annotation": "i73", "points": "p10*"},
    "TOLERANCE": {"insert": "p10", "direction": "p11", "style": "s3", "text": "s1"},
    "MLINE": {"style": "s2", "scale": "d40", "justification": "i70", "flags": "i71", "base": "p10", "points": "p11*"},
    "HATCH": {"pattern": "s2", "solid": "i70", "associative": "i71", "n_paths": "i91", "elevation": "d30", "hatch_style": "i75", "pattern_type": "i76", "angle": "d52", "scale": "d41", "extrusion": "p210"},
    "3DFACE": {"p1": "p10", "p2": "p11", "p3": "p12", "p4": "p13", "hidden_edges": "i70"},
    "SOLID": {"p1": "p10", "p2": "p11", "p3": "p12", "p4": "p13", "thickness": "d39"},
    "TRACE": {"p1": "p10", "p2": "p11", "p3": "p12", "p4": "p13", "thickness": "d39"},
    "SHAPE": {"insert": "p10", "name": "s2", "size": "d40", "rotation": "d50", "width_factor": "d41", "oblique": "d51"},
    "VIEWPORT": {"center": "p10", "width": "d40", "height": "d41", "status": "i68", "number": "i69"},
}
#: Kinds of dimensions by the lowest three bits of their flags.
DIMENSIONS = ("LINEAR", "ALIGNED", "ANGULAR2LN", "DIAMETER", "RADIUS", "ANGULAR3PT", "ORDINATE")
#: Header variables with their kind and group code.
VARIABLES = {
    "insunits": ("int", 70), "lunits": ("int", 70), "luprec": ("int", 70), "aunits": ("int", 70), "auprec": ("int", 70), "ltscale": ("double", 40), "textsize": ("double", 40),
    "extmin": ("point", 10), "extmax": ("point", 10), "limmin": ("point", 10), "limmax": ("point", 10),
}


def _let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, codes) of all files under ``path``: the pairs (k, code, value) of each section, from its name on; unpaired last lines are left out.

    The pairs of a file are told apart in its row, so none of them is
    shuffled. Sections of one name are one row; a file without any has one
    row of nulls.
    """

    def each(line: Column) -> Column:
        last = F.floor(F.size(line) / 2).cast("int")
        return F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(k.alias("k"), F.trim(F.get(line, 2 * k - 2)).alias("code"), F.get(line, 2 * k - 1).alias("value")))

    def sections(codes: Column) -> Column:
        after = lambda m: F.get(codes, m["k"])
        mark = lambda k, name: F.struct(k.alias("k"), name.alias("section"))
        ends = F.filter(codes, lambda p: (p["code"] == "0") & p["value"].isin("SECTION", "ENDSEC"))
        ends = F.filter(ends, lambda m: (m["value"] == "ENDSEC") | (after(m)["code"] == "2"))
        return F.transform(ends, lambda m: F.when(m["value"] == "ENDSEC", mark(m["k"], F.lit(""))).otherwise(mark(m["k"] + 1, after(m)["value"])))

    def cut_up(codes: Column) -> Column:
        span = lambda marks: F.transform(marks, lambda m, i: F.struct(m["section"].alias("section"), F.slice(codes, m["k"], F.coalesce(F.get(marks, i + 1)["k"], F.size(codes) + 1) - m["k"]).alias("codes")))
        named = lambda spans: F.array_remove(F.array_distinct(F.transform(spans, lambda p: p["section"])), "")
        one = lambda spans, name: F.struct(name.alias("section"), F.flatten(F.transform(F.filter(spans, lambda p: p["section"] == name), lambda p: p["codes"])).alias("codes"))
        return _let(_let(sections(codes), span), lambda spans: F.transform(named(spans), lambda name: one(spans, name)))

    files = spark.read.text(path, wholetext=True).where(F.col("value").rlike("[\r\n]"))
    # outer, as else the optimizer works the list out once more to test that it isn't empty
    cut_files = files.select(F.input_file_name().alias("file"), F.explode_outer(_let(_let(F.split("value", "\r\n|\n|\r"), each), cut_up)).alias("s"))
    return cut_files.select("file", "s.section", "s.codes")


def records(pair: DataFrame, section: str = "ENTITIES") -> DataFrame:
    """One row for each record of a section: file, ord, dxftype, handle, owner, layer, linetype, color_index, true_color, paper and ``codes``, its pairs in order.

    The owner is the last one named before the first subclass, as reactors
    are named before it. ``paper`` is true for paper space. Values that can't
    be read are null.
    """

    def cut_up(codes: Column) -> Column:
        heads = F.filter(F.transform(codes, lambda p, i: F.when(p["code"] == "0", i + 1)), lambda i: i.isNotNull())
        return _let(heads, lambda hs: F.transform(hs, lambda h, i: F.struct((i + 1).cast("long").alias("ord"), F.slice(codes, h, F.coalesce(F.get(hs, i + 1), F.size(codes) + 1) - h).alias("codes"))))

    df = pair.where(F.col("section") == section).select("file", F.explode_outer(_let(F.col("codes"), cut_up)).alias("r")).select("file", "r.ord", "r.codes")
    df = df.where(~F.coalesce(F.get("codes", F.lit(0))["value"].isin("SECTION", "ENDSEC"), F.lit(True)))
    at = F.array_position(F.col("codes.code"), "100").cast("int")
    owners = F.expr("filter(if(__at > 0, slice(codes, 1, __at), codes), c -> c.code = '330').value")
    df = df.withColumn("__at", at).withColumn("__owner", F.try_element_at(owners, F.lit(-1)))
    return df.select(
        "file",
        "ord",
        _first("0").alias("dxftype"),
        _number(_first("5")).alias("handle"),
        _number(F.col("__owner")).alias("owner"),
        _first("8").alias("layer"),
        _first("6").alias("linetype"),
        _read("i62").alias("color_index"),
        _read("i420").alias("true_color"),
        F.coalesce(_read("i67") == 1, F.lit(False)).alias("paper"),
        "codes",
    ).where("dxftype is not null")


def _all(code: str) -> Column:
    """All values of a group code, in order."""
    return F.expr(f"filter(codes, c -> c.code = '{code}').value")


def _first(code: str) -> Column:
    return F.try_element_at(_all(code), F.lit(1))


def _number(digits: Column) -> Column:
    return F.conv(F.trim(digits), 16, 10).cast("long")


def _read(what: str) -> Column:
    """The field that a mark of FIELDS names."""
    kind, code, many = what[0], what[1:].rstrip("*"), what.endswith("*")
    if kind == "p":
        lists = [_read(f"d{int(code) + step}*") for step in (0, 10, 20)]
        if many:
            return F.arrays_zip(*[x.alias(n) for x, n in zip(lists, "xyz", strict=True)])
        one = [F.try_element_at(x, F.lit(1)) for x in lists]
        return F.when(one[0].isNotNull() | one[1].isNotNull(), F.struct(*[x.alias(n) for x, n in zip(one, "xyz", strict=True)]))
    to = {"d": "double", "i": "int", "s": "string"}[kind]
    each = F.transform(_all(code), lambda v: v.try_cast(to) if to == "string" else F.trim(v).try_cast(to))
    return each if many else F.try_element_at(each, F.lit(1))


def fields(record: DataFrame, dxftype: str) -> DataFrame:
    """The records of one type with its own fields in place of ``codes``.

    * INSERT and MINSERT are told apart by rows and columns; scales that
      aren't given are 1.
    * DIMENSION has the name of its kind in ``dimtype``; MTEXT the whole of
      its text; LWPOLYLINE ``points`` with widths and bulges.
    * Fields that a record doesn't have are null, lists empty.
    """
    raw = "INSERT" if dxftype == "MINSERT" else dxftype
    own = record.where(F.col("dxftype") == raw)
    df = own.select(*own.columns, *[_read(what).alias(name) for name, what in FIELDS[raw].items()])
    if raw == "INSERT":
        df = df.withColumns({c: F.coalesce(c, F.lit(1.0)) for c in ("sx", "sy", "sz")} | {"rotation": F.coalesce("rotation", F.lit(0.0))} | {c: F.coalesce(c, F.lit(1)) for c in ("n_columns", "n_rows")})
        several = (F.col("n_columns") > 1) | (F.col("n_rows") > 1)
        df = df.where(several if dxftype == "MINSERT" else ~several).withColumn("dxftype", F.lit(dxftype))
    elif raw == "DIMENSION":
        names = F.array(*map(F.lit, DIMENSIONS))
        df = df.withColumn("dimtype", F.try_element_at(names, F.coalesce(F.col("flags").bitwiseAND(F.lit(7)), F.lit(0)) + 1))
    elif raw == "MTEXT":
        df = df.withColumn("text", F.concat(F.array_join(_all("3"), ""), F.coalesce("text", F.lit(""))))
    elif raw == "SPLINE":
        bit = lambda n: F.coalesce(F.col("flags").bitwiseAND(F.lit(n)) > 0, F.lit(False))
        df = df.withColumns({"closed": bit(1), "periodic": bit(2), "rational": bit(4)})
    elif raw == "LWPOLYLINE":
        # the codes of a vertex go from its x to the next one's
        df = df.withColumn("__at", F.expr("filter(sequence(1, size(codes)), i -> codes[i - 1].code = '10')"))
        df = df.withColumn("__v", F.expr("transform(__at, (a, j) -> slice(codes, a, coalesce(get(__at, j + 1), size(codes) + 1) - a))"))
        value = lambda code, other: f"coalesce(try_cast(trim(get(filter(v, c -> c.code = '{code}').value, 0)) as double), {other})"
        parts = {"x": value(10, "null"), "y": value(20, "null"), "start_width": value(40, "0D"), "end_width": value(41, "0D"), "bulge": value(42, "0D")}
        df = df.withColumn("points", F.expr(f"transform(__v, v -> named_struct({', '.join(f'{n!r}, {v}' for n, v in parts.items())}))")).drop("__at", "__v")
        df = df.withColumn("closed", F.coalesce(F.col("flags").bitwiseAND(F.lit(1)) > 0, F.lit(False)))
    return df.drop("codes")


def layers(pair: DataFrame) -> DataFrame:
    """(file, handle, name, color_index, true_color, linetype, off, frozen, locked) of the layer table; a layer that is off has its colour negated in the file."""
    flag = lambda n: F.coalesce(_read("i70").bitwiseAND(F.lit(n)) > 0, F.lit(False))
    df = records(pair, "TABLES").where("dxftype = 'LAYER'")
    return df.select("file", "handle", _first("2").alias("name"), F.abs("color_index").alias("color_index"), "true_color", "linetype", F.coalesce(F.col("color_index") < 0, F.lit(False)).alias("off"), flag(1).alias("frozen"), flag(4).alias("locked"))


def block_headers(pair: DataFrame) -> DataFrame:
    """(file, handle, name) of the block records."""
    return records(pair, "TABLES").where("dxftype = 'BLOCK_RECORD'").select("file", "handle", _first("2").alias("name"))


def block_members(pair: DataFrame) -> DataFrame:
    """The records of the blocks' section with ``block``, the name of the block that they are in; opening and closing records included."""
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return records(pair, "BLOCKS").withColumn("block", F.last(F.when(F.col("dxftype") == "BLOCK", F.coalesce(_first("2"), F.lit(""))), ignorenulls=True).over(w))


def entities(pair: DataFrame) -> DataFrame:
    """One row for each entity: file, ord, dxftype, handle, layer, owner, colours, space, numbers by their field, and ``points`` of polylines."""
    df = records(pair)
    numbers = [_read(f"d{c}").alias(n) for c, n in NUMBERS.items()]
    points = F.arrays_zip(_read("d10*").alias("x"), _read("d20*").alias("y")).alias("points")
    return df.select(*[c for c in df.columns if c != "codes"], _first("1").alias("text"), *numbers, points)


def header_variables(pair: DataFrame) -> DataFrame:
    """One row for each file with the variables of VARIABLES; null where a file doesn't have one, and in the two versions without units."""
    df = pair.select("file").distinct().join(header(pair), "file", "left")
    value = lambda name, code: F.min(F.when((F.col("name") == name) & (F.col("code") == str(code)), F.trim("value")))
    version = value("$ACADVER", 1)
    known = ~F.coalesce(version.isin("AC1012", "AC1014"), F.lit(False))
    out = [version.alias("version")]
    for name, (kind, code) in VARIABLES.items():
        own = "$" + name.upper()
        if kind == "point":
            xyz = [value(own, c).try_cast("double").alias(n) for c, n in zip((10, 20, 30), "xyz", strict=True)]
            out.append(F.when(known & value(own, 10).isNotNull(), F.struct(*xyz)).alias(name))
        else:
            out.append(F.when(known, value(own, code).try_cast(kind)).alias(name))
    return df.groupBy("file").agg(*out)


def header(pair: DataFrame) -> DataFrame:
    """(file, name, code, value) of the header's variables."""
    w = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    df = pair.where("section = 'HEADER'").select("file", F.explode("codes").alias("p")).select("file", "p.*").withColumn("name", F.last(F.when(F.col("code") == "9", F.col("value")), ignorenulls=True).over(w))
    return df.where("code <> '9' and name is not null and code <> '0'").select("file", "name", "code", "value")


def _pair(code: int, value: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), value.cast("string").alias("value"))


def group_codes(rows: DataFrame) -> DataFrame:
    """``rows`` (handle, dxftype, layer, x, y, x2, y2, r, start, end, text, points) with ``codes``, the pairs of each entity; null for types that aren't written.

    ``points`` (array of x and y) may be missing; then polylines aren't
    written. Rays and construction lines have their direction in (x2, y2).
    """
    head = [_pair(0, F.col("dxftype")), _pair(5, F.hex("handle")), _pair(8, F.coalesce(F.col("layer"), F.lit("0")))]
    at = [_pair(10, F.col("x")), _pair(20, F.col("y")), _pair(30, F.lit(0.0))]
    body = {
        "LINE": [*at, _pair(11, F.col("x2")), _pair(21, F.col("y2")), _pair(31, F.lit(0.0))],
        "POINT": at,
        "CIRCLE": [*at, _pair(40, F.col("r"))],
        "ARC": [*at, _pair(40, F.col("r")), _pair(50, F.col("start")), _pair(51, F.col("end"))],
        "TEXT": [*at, _pair(40, F.col("r")), _pair(1, F.regexp_replace("text", "[\r\n]+", " "))],
    }
    body["RAY"] = body["XLINE"] = body["LINE"]
    body["MTEXT"] = [*at, _pair(40, F.col("r")), _pair(1, F.regexp_replace("text", "\r\n|\r|\n", r"\\P"))]
    codes = F.lit(None)
    if "points" in rows.columns:
        each = F.flatten(F.transform("points", lambda p: F.array(_pair(10, p["x"]), _pair(20, p["y"]))))
        line = F.concat(F.array(*head, _pair(90, F.size("points")), _pair(70, F.lit(0))), each)
        codes = F.when((F.col("dxftype") == "LWPOLYLINE") & (F.size("points") > 0), line)
    for t, b in body.items():
        codes = F.when(F.col("dxftype") == t, F.array(*head, *b)).otherwise(codes)
    return rows.withColumn("codes", codes)


def write(rows: DataFrame, path: str) -> DataFrame:
    """Writes the entities as exchange files under ``path``; returns (dxftype, written, skipped).

    Types without a writer are skipped and counted. Every part is a complete
    file in a folder of its own, of at most 65,536 entities, so that a large
    drawing is written and read by many tasks.
    """
    df = group_codes(rows)
    text = F.array_join(F.transform("codes", lambda p: F.concat(p["code"].cast("string"), F.lit("\n"), F.coalesce(p["value"], F.lit("")))), "\n")
    # the id has its partition and its place there
    kept = df.select(F.shiftright(F.monotonically_increasing_id(), 16).alias("part"), "handle", text.alias("value")).where("value is not null")
    w = Window.partitionBy("part").orderBy("handle")
    first, last = F.when(F.row_number().over(w) == 1, "0\nSECTION\n2\nENTITIES\n").otherwise(""), F.when(F.lead(F.lit(1)).over(w).isNull(), "\n0\nENDSEC\n0\nEOF").otherwise("")
    kept.select("part", F.concat(first, "value", last).alias("value")).write.partitionBy("part").text(path)
    return df.groupBy("dxftype").agg(F.count_if(F.col("codes").isNotNull()).alias("written"), F.count_if(F.col("codes").isNull()).alias("skipped"))
