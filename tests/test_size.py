"""How much leaves the joins of queries whose pairs outgrow their input, and their results on odd rows."""

import random

from pyspark.sql import functions as F

from plumbline.operators import graph, spatial
from plumbline.sources import dxf


def shuffled(df):
    """The rows that the exchanges of a plan wrote; ``df`` is run for it."""
    df.collect()

    def of(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return of(node.executedPlan())
        if "QueryStage" in name:
            return of(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(of(below.apply(i)) for i in range(below.size()))

    return of(df._jdf.queryExecution().executedPlan())


def nearest_layers(points, boxes):
    near = lambda d, a, m, z: 6 if d <= a else 3 if d <= m else 1 if d <= z else 0
    total = {}
    for i, x, y in points:
        for layer, x1, x2, y1, y2, w in boxes:
            dx, dy = max(x1 - x, x - x2, 0), max(y1 - y, y - y2, 0)
            if dx <= 1600 and dy <= 900:
                total[i, layer] = total.get((i, layer), 0) + w + near(dx, 100, 400, 900) + near(dy, 80, 250, 600)
    best = {}
    for (i, layer), s in total.items():
        best[i] = max(best.get(i, (-(10**9), 0)), (s, -layer))
    return {i: (-layer, s) for i, (s, layer) in best.items()}


def test_layers_near_points_with_several_boxes_and_repeated_ids(spark):
    rng = random.Random(3)
    points = [(i if i < 60 else i % 7, float(rng.randrange(9000)), float(rng.randrange(6000))) for i in range(90)] + [(5, 4000.0, 3000.0)] * 2
    boxes = [(n % 11, float(x), float(x + rng.choice((0, 700, 2500))), float(y), float(y + 1200), n % 4 + 1) for n in range(24) for x, y in [(rng.randrange(9000), rng.randrange(6000))]]
    boxes += [boxes[0], (40, 0.0, 9000.0, 0.0, 6000.0, 3), (39, 0.0, 9000.0, 0.0, 6000.0, 3)]
    got = spatial.nearby_layer(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(boxes, "layer_handle long, min_x double, max_x double, min_y double, max_y double, weight long"))
    assert {r.id: (r.layer_handle, r.score) for r in got.collect()} == nearest_layers(points, boxes)


def test_pairs_of_points_and_layers_are_not_shuffled(spark):
    n, m = 1000, 100
    points = spark.range(n).select("id", (F.col("id") % 50 * 10.0).alias("x"), (F.col("id") % 40 * 10.0).alias("y"))
    at = [(F.col("id") % 9 * 20.0 + by).alias(c) for c, by in (("min_x", 0), ("max_x", 300), ("min_y", 0), ("max_y", 300))]
    boxes = spark.range(m).select(F.col("id").alias("layer_handle"), *at, (F.col("id") % 4).alias("weight"))
    df = spatial.nearby_layer(points, boxes)
    assert df.count() == n
    assert shuffled(df) < n * m / 2


def test_pairs_of_exchange_files_are_not_shuffled(spark, tmp_path):
    rows = spark.range(200).selectExpr("id as handle", "'POINT' as dxftype", "'0' as layer", "1.5D as x", "2.5D as y", "0D as x2", "0D as y2", "1D as r", "0D as start", "0D as end", "'' as text")
    dxf.write(rows, str(tmp_path / "out"))
    df = dxf.entities(dxf.pairs(spark, str(tmp_path / "out"))).select("handle", "x", "y")
    assert sorted(map(tuple, df.collect())) == [(n, 1.5, 2.5) for n in range(200)]
    assert shuffled(df) == 0


def test_sections_repeated_unclosed_or_without_a_name(spark, tmp_path):
    section, end = ["0", "SECTION", "2"], ["0", "ENDSEC"]
    line = lambda handle: ["0", "LINE", "5", handle, "8", "0"]
    lines = [*line("9"), *section, "HEADER", "9", "$INSUNITS", "70", "4", *section, "ENTITIES", *line("A"), *line("B"), "0", "SECTION", "5", "C", *line("D"), *end, *line("E"), *section, "ENTITIES", *line("F"), "8"]
    (tmp_path / "odd.dxf").write_text("\r\n".join(lines))
    (tmp_path / "bare.dxf").write_text("\n".join(line("1")))
    (tmp_path / "empty.dxf").write_text("")
    pair = dxf.pairs(spark, str(tmp_path))
    assert [(r.handle, r.ord) for r in dxf.records(pair).orderBy("ord").collect()] == [(0xA, 1), (0xB, 2), (0xD, 4), (0xF, 5)]
    assert {r.file.rsplit("/", 1)[1]: r.insunits for r in dxf.header_variables(pair).collect()} == {"odd.dxf": 4, "bare.dxf": None}
    assert [(r.name, r.value) for r in dxf.header(pair).collect()] == [("$INSUNITS", "4")]


def test_edges_are_counted_where_entities_are(spark):
    n = 400
    rows = spark.range(n).selectExpr("id + 1000 as handle", "'LINE' as dxftype", "id % 5 as owner_handle", "id % 3 + 1 as layer_handle", "array(id % 2, 7, 7, null, id + 1000) as reactor_handles", "if(id % 4 = 0, array(id + 1001), null) as handle_refs")
    again = rows.union(rows.where("handle < 1010"))
    df = graph.degrees(again)
    e = {(r.src, r.kind, r.dst) for r in graph.edges(again).collect()}
    want = {}
    for src, kind, dst in e:
        for at, way in ((src, 0), (dst, 1)):
            own = want.setdefault((at, kind), [0, 0, None])
            own[way] += 1
            if way:
                own[2] = src if own[2] is None else min(own[2], src)
    assert {(r.handle, r.kind): [r.n_from, r.n_to, r.first] for r in df.collect()} == want
    assert len(e) > 3 * n and shuffled(df) < len(e)
