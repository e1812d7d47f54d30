"""Operators on literal rows, exchange files and streams."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.functions import colours as C
from plumbline.functions import geometry as G
from plumbline.functions import text as X
from plumbline.operators import assembly, colours, dedup, graph, records, select, spatial
from plumbline.plans import catalogue
from plumbline.session import cut
from plumbline.sources import dxf
from plumbline.streaming import arrivals


def test_type_plan():
    assert catalogue.planned(None, ["LINE", "ARC", "SEQEND"]) == ["LINE", "ARC"]
    assert catalogue.planned("arc, line ARC") == ["ARC", "LINE"]
    assert catalogue.planned("NOPE") == []
    assert catalogue.planned("DIM_LINEAR") == ["DIMENSION"]
    assert catalogue.planned("VERTEX_*", ["VERTEX_2D", "LINE"]) == ["VERTEX_2D"]
    assert catalogue.planned("* LINE", ["ARC"]) == ["ARC"]
    assert len(catalogue.TYPES) == 43


def usage(spark, counts):
    rows = [(layer,) for layer, n in counts for _ in range(n)]
    return spark.createDataFrame(rows or [(None,)], "layer_handle long").where("layer_handle is not null")


@pytest.mark.parametrize(
    ("counts", "layers", "version", "want"),
    [
        ([(896, 64), (16, 1)], [(16, 7), (896, 9), (897, 5)], "AC1024", {896: 5, 16: 9}),
        ([(1000, 50), (10, 10)], [(10, 7), (1000, 9), (2000, 5)], "AC1027", {1000: 5, 10: 9}),
        ([(896, 1), (897, 1)], [(16, 7), (896, 9), (897, 5)], "AC1024", {}),
        ([(896, 64), (16, 1)], [(16, 7), (896, 9), (897, 5)], "AC1015", {}),
    ],
)
def test_layer_overrides(spark, counts, layers, version, want):
    table = spark.createDataFrame([(h, c, None) for h, c in layers], "handle long, color_index int, true_color long")
    got = colours.layer_overrides(usage(spark, counts), table, version)
    assert {r.handle: r.color_index for r in got.collect()} == want


def test_records(spark):
    df = spark.createDataFrame([(237, 527255), (237, 12157), (237, 204892)], "handle long, off long")
    assert [tuple(r) for r in records.by_max_offset(df).collect()] == [(237, 527255)]
    coded = spark.createDataFrame([(0, 1, 10), (1, 2, 4), (2, 7, 8), (3, 2, 3)], "ord int, d_handle long, d_off long")
    got = records.undelta(coded, None, ["ord"], ["handle", "off"]).orderBy("ord")
    assert [(r.handle, r.off) for r in got.collect()] == [(1, 10), (3, 14), (10, 22), (12, 25)]


def test_numbering_passes_over_used_names(spark):
    df = spark.createDataFrame([(1, 5, "*U"), (1, 6, "*D"), (1, 7, "*U1"), (1, 8, "*D3"), (1, 9, "*T"), (1, 3, "*U")], "p int, handle long, name string")
    assert {r.handle: r.name for r in records.numbered(df, "p").collect()} == {3: "*U2", 5: "*U4", 6: "*D5", 9: "*T6"}


def test_adjacent_runs_cross_blocks(spark):
    parents = spark.createDataFrame([(4090,), (10,), (20,)], "handle long")
    kids = spark.createDataFrame([(h,) for h in [*range(4091, 4100), 11, 12, 14, 19, 22]], "handle long")
    got = {}
    for r in assembly.adjacent(parents, kids).collect():
        got.setdefault(r.handle, []).append(r.child)
    assert {k: sorted(v) for k, v in got.items()} == {4090: list(range(4091, 4100)), 10: [11, 12]}


def test_stack_ignores_stray_closes(spark):
    rows = [(1, i, k) for i, k in enumerate("CxO1xO2xCxCxCCxO3x".replace("1", "").replace("2", "").replace("3", ""))]
    df = spark.createDataFrame(rows, "f int, at int, kind string")
    got = {r.at: (r.depth, r.inside) for r in graph.stack_top(df, "f", ["at"], "kind = 'O'", "kind = 'C'", "at").where("kind = 'x'").collect()}
    stack, want = [], {}
    for _, i, k in rows:
        if k == "x":
            want[i] = (len(stack), stack[-1] if stack else None)
        elif k == "O":
            stack.append(i)
        elif stack:
            stack.pop()
    assert got == want


def test_graph_on_cycles(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, 7), (None, 1)], "src long, dst long")
    roots = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert {r.node: r.depth for r in graph.closure(pairs, roots).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {tuple(r) for r in graph.cycle_edges(pairs).collect()} == {(1, 2), (2, 3), (3, 1), (5, 5)}
    assert {tuple(r) for r in graph.resolved(pairs.where("src is not null")).collect()} == {(1, 2), (2, 3), (3, 1), (5, 5)}


def test_searches_go_on_until_done(spark):
    """A chain longer than any fixed number of steps."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(90)], "src long, dst long")
    got = {r.node: r.depth for r in graph.closure(pairs, spark.createDataFrame([(0,)], "node long")).collect()}
    assert got == {i: i for i in range(91)}
    nodes = spark.createDataFrame([(i,) for i in range(95)], "node long")
    assert {r.node for r in graph.purged(nodes, pairs, spark.createDataFrame([(0,)], "node long")).collect()} == set(range(91, 95))


@pytest.mark.parametrize("path", [[1, *range(102, 1, -1)], list(range(100)), [(i * 37) % 101 for i in range(101)]])
def test_components_of_paths_in_few_rounds(spark, monkeypatch, path):
    """Falling, rising and shuffled paths; the number of interim results is logarithmic."""
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df, rows=None, cut=graph.cut: (cuts.append(1), cut(df, rows))[1])
    edges = spark.createDataFrame([*zip(path, path[1:]), (1000, 1001), (2000, 2000)], "a long, b long")
    got = {r.node: r.label for r in graph.components(edges, "a", "b").collect()}
    assert got == {**{i: min(path) for i in path}, 1000: 1000, 1001: 1000, 2000: 2000}
    assert len(cuts) <= 30
    more = graph.merged(graph.components(edges, "a", "b"), spark.createDataFrame([(1001, path[5]), (3000, 2000)], "a long, b long"), "a", "b")
    assert {r.node: r.label for r in more.collect()} == {**{i: min(path) for i in path}, 1000: min(path), 1001: min(path), 2000: 2000, 3000: 2000}


def test_the_rest_works_without_the_optional_modules(tmp_path):
    """A copy without the llm folders still imports and has its queries, with and without the pipeline's module."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    run = "import __spark_entry__ as e; from plumbline.plans import registry as r; assert set(e.queries()) == set(r.QUERIES) and set(e.oracle_sql()) == set(r.ORACLES); import bench"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", run], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin"})
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)


def test_clusters_match_brute_force(spark):
    points = [(i, float(i * 7919 % 503), float(i * 104729 % 499)) for i in range(150)]
    got = {r.id: r.cluster for r in spatial.clusters(spark.createDataFrame(points, "id long, x double, y double"), 30.0).collect()}
    label = {p[0]: p[0] for p in points}
    for _ in points:
        for a, ax, ay in points:
            for b, bx, by in points:
                if (ax - bx) ** 2 + (ay - by) ** 2 <= 900:
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_catmull_rom_matches_loop(spark):
    pts = [(0.0, 0.0), (1.0, 2.0), (3.0, 1.0), (4.0, 4.0)]
    df = spark.createDataFrame([([dict(x=x, y=y) for x, y in pts],)], "p array<struct<x:double,y:double>>")
    got = [(p.x, p.y) for p in df.select(G.catmull_rom(F.col("p"), 4).alias("c")).first().c]
    want = []
    for i in range(3):
        q = [pts[max(i - 1, 0)], pts[i], pts[i + 1], pts[min(i + 2, 3)]]
        t = [0.0]
        for a, b in zip(q, q[1:]):
            t.append(t[-1] + max(math.sqrt(math.dist(a, b)), 1e-6))
        for k in range(0 if i == 0 else 1, 5):
            u = t[1] + (t[2] - t[1]) * k / 4
            mix = lambda a, b, s, e: tuple(x * (e - u) / (e - s) + y * (u - s) / (e - s) for x, y in zip(a, b))
            a1, a2, a3 = (mix(q[j], q[j + 1], t[j], t[j + 1]) for j in range(3))
            want.append(mix(mix(a1, a2, t[0], t[2]), mix(a2, a3, t[1], t[3]), t[1], t[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, abs=1e-9)


def test_bspline_matches_basis(spark):
    pts = [(0.0, 0.0), (1.0, 3.0), (4.0, 2.0), (5.0, -1.0), (7.0, 0.0)]
    df = spark.createDataFrame([([dict(x=x, y=y) for x, y in pts],)], "p array<struct<x:double,y:double>>")
    got = [(p.x, p.y) for p in df.select(G.bspline(F.col("p"), 3, 10).alias("c")).first().c]
    t = [0, 0, 0, 0, 1, 2, 2, 2, 2]

    def basis(i, p, u):
        if p == 0:
            return float(t[i] <= u < t[i + 1] or (u == t[-1] and t[i] < t[i + 1] == u))
        left = (u - t[i]) / (t[i + p] - t[i]) * basis(i, p - 1, u) if t[i + p] > t[i] else 0.0
        right = (t[i + p + 1] - u) / (t[i + p + 1] - t[i + 1]) * basis(i + 1, p - 1, u) if t[i + p + 1] > t[i + 1] else 0.0
        return left + right

    for s, g in enumerate(got):
        u = 2 * s / 10
        assert g == pytest.approx(tuple(sum(basis(i, 3, u) * p[c] for i, p in enumerate(pts)) for c in (0, 1)), abs=1e-9)
    assert len(got) == 11


@pytest.mark.parametrize(
    ("markup", "plain"),
    [(r"a\Pb", "a\nb"), (r"{\fArial;x}", "x"), (r"\\P \{y\}", r"\P {y}"), (r"\S1#2;z", "1/2z"), (r"\U+00e9\~\Lq\l", "é q"), ("", ""), (None, ""), ("end\\", "end\\"), (r"\A1;k\H3", "k")],
)
def test_mtext(spark, markup, plain):
    assert spark.createDataFrame([(markup,)], "t string").select(X.plain_mtext(F.col("t"))).first()[0] == plain


def test_colours(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 9, 10, 34, 249, 250, 255, 256, None)], "i int")
    got = [r[0] for r in df.select(C.index_hex(F.col("i"))).collect()]
    assert got[:4] == [None, "#ff0000", "#c0c0c0", "#ff0000"] and got[6:] == ["#000000", "#ffffff", None, None]


def test_empty_and_text_dedup(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 1), (4, "b", 1), (5, "a", 0)], "id int, k string, rank int")
    assert sorted(r.id for r in dedup.by_source(df, ["k"], "rank", ["id"]).collect()) == [1, 3, 5]
    assert select.of_types(spark.createDataFrame([("LINE",)], "dxftype string"), []).count() == 0


def exchange_file(*entity):
    head = ["0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", "AC1021", "9", "$INSUNITS", "70", "     4", "0", "ENDSEC"]
    return "\r\n".join([*head, "0", "SECTION", "2", "ENTITIES", *entity, "0", "ENDSEC", "0", "EOF"]) + "\r\n"


def test_exchange_files(spark, tmp_path):
    common = ["330", "1F", "100", "AcDbEntity", "8", "0"]
    files = {
        "line": ["0", "LINE", "5", "83", *common, " 10", "50.0", " 20", "50.0", " 30", "0.0", " 11", "100.0", " 21", "100.0", " 31", "0.0"],
        "arc": ["0", "ARC", "5", "83", *common, " 10", "75.0", " 20", "50.0", " 40", "25.0", " 50", "0.0", " 51", "180.0"],
        "text": ["0", "MTEXT", "5", "84", *common, " 10", "50.0", " 20", "50.0", " 40", "5.0", "  1", "Hello  text"],
        "poly": ["0", "LWPOLYLINE", "5", "7C", *common, " 90", "3", " 70", "0", " 10", "50.0", " 20", "50.0", " 10", "100.0", " 20", "100.0", " 10", "150.0", " 20", "50.0"],
        "none": [],
    }
    for name, entity in files.items():
        (tmp_path / f"{name}.dxf").write_bytes(exchange_file(*entity).encode())
    pair = dxf.pairs(spark, str(tmp_path)).cache()
    rows = {Path(r.file).stem: r for r in dxf.entities(pair).collect()}
    assert set(rows) == {"line", "arc", "text", "poly"}
    assert rows["line"].dxftype == "LINE" and rows["line"].handle == 0x83 and rows["line"].x2 == 100.0 and rows["line"].owner == 0x1F
    assert rows["arc"].end == 180.0 and rows["arc"].r == 25.0 and rows["text"].text == "Hello  text"
    assert [(p.x, p.y) for p in rows["poly"].points] == [(50, 50), (100, 100), (150, 50)]
    units = dxf.header(pair).where("name = '$INSUNITS'")
    assert [r.value.strip() for r in units.collect()] == ["4"] * 5


def test_exchange_round_trip(spark, tmp_path):
    rows = [(1, "LINE", "0", 1.0, 2.0, 3.0, 4.0, None, None, None, None), (2, "ARC", "A", 5.0, 6.0, None, None, 2.5, 10.0, 90.0, None), (3, "TEXT", None, 0.0, 0.0, None, None, 1.5, None, None, "two\nlines"), (4, "HATCH", "0", 0.0, 0.0, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "handle long, dxftype string, layer string, x double, y double, x2 double, y2 double, r double, start double, end double, text string")
    counts = {r.dxftype: (r.written, r.skipped) for r in dxf.write(df, str(tmp_path / "out")).collect()}
    assert counts == {"LINE": (1, 0), "ARC": (1, 0), "TEXT": (1, 0), "HATCH": (0, 1)}
    back = {r.handle: r for r in dxf.entities(dxf.pairs(spark, str(tmp_path / "out"))).collect()}
    assert set(back) == {1, 2, 3} and back[1].x2 == 3.0 and back[2].end == 90.0 and back[3].text == "two lines" and back[3].layer == "0"


def test_every_writable_type_comes_back(spark, tmp_path):
    points = [dict(x=0.0, y=1.0), dict(x=2.5, y=3.0), dict(x=4.0, y=-1.0)]
    rows = [(i, t, "A", 1.0, 2.0, 3.0, 4.0, 2.5, 10.0, 90.0, "one\ntwo", points) for i, t in enumerate(catalogue.WRITABLE, 1)]
    df = spark.createDataFrame(rows, "handle long, dxftype string, layer string, x double, y double, x2 double, y2 double, r double, start double, end double, text string, points array<struct<x:double,y:double>>").repartition(3)
    counts = {r.dxftype: (r.written, r.skipped) for r in dxf.write(df, str(tmp_path / "out")).collect()}
    assert counts == {t: (1, 0) for t in catalogue.WRITABLE}
    back = {r.dxftype: r for r in dxf.entities(dxf.pairs(spark, str(tmp_path / "out"))).collect()}
    assert {t: r.handle for t, r in back.items()} == {t: i for i, t in enumerate(catalogue.WRITABLE, 1)}
    assert [(p.x, p.y) for p in back["LWPOLYLINE"].points] == [(0, 1), (2.5, 3), (4, -1)]
    assert back["RAY"].x2 == back["XLINE"].x2 == 3.0 and back["MTEXT"].text == "one\\Ptwo"
    files = [p.read_text() for p in (tmp_path / "out").rglob("*.txt")]
    assert len(files) == 3 and all(f.count("EOF") == 1 and f.count("ENTITIES") == 1 for f in files)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = arrivals.windowed_counts(arrivals.arriving(spark, str(tmp_path / "in"), events.schema, 1), "ts", "event_type")
    q = stream.writeStream.format("memory").queryName("arrived").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.sql("select * from arrived")) == key(arrivals.windowed_counts(events, "ts", "event_type"))


def test_cycles_and_searches_take_few_rounds_on_long_walks(spark, monkeypatch):
    calls = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda *a: calls.append(1) or real(*a))
    ring = [(i, (i + 1) % 300) for i in range(300)]
    tail = [(1000 + i, 1001 + i) for i in range(100)] + [(1100, 0)]
    pairs = spark.createDataFrame(ring + tail, "src long, dst long")
    assert sorted(map(tuple, graph.cycle_edges(pairs).collect())) == sorted(ring)
    found = {r.node: r.depth for r in graph.closure(pairs, spark.createDataFrame([(1000,), (150,)], "node long")).collect()}
    assert found == {1000 + i: i for i in range(101)} | {(150 + i) % 300: min(i, 101 + (150 + i) % 300) for i in range(300)}
    assert len(calls) < 60


def test_cycles_through_chains_and_branches(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        given = {(rng.randrange(40), rng.randrange(40)) for _ in range(50)}
        ahead = {n: {d for s, d in given if s == n} for n in range(40)}

        def reached(start, ahead=ahead):
            seen, todo = set(), [start]
            while todo:
                for d in ahead[todo.pop()] - seen:
                    seen.add(d)
                    todo.append(d)
            return seen

        want = sorted((s, d) for s, d in given if s == d or s in reached(d))
        assert sorted(map(tuple, graph.cycle_edges(spark.createDataFrame(list(given), "src long, dst long")).collect())) == want


def test_totals_of_flattened_blocks(spark):
    from plumbline.operators import blocks

    roots = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "root long, block long")
    inserts = spark.createDataFrame([(1, 2, 3.0, 4.0, 2.0, 0.5, 30.0), (1, 2, 1.0, 1.0, 1.0, 1.0, 0.0), (2, 3, 5.0, 0.0, 1.5, 1.0, 75.0), (3, 1, 0.0, 2.0, 1.0, 3.0, 10.0)], "block long, child long, x double, y double, sx double, sy double, rotation double")
    members = spark.createDataFrame([(1, 1, 1.0, 2.0), (2, 2, 3.0, 4.0), (2, 3, 0.5, 0.0), (3, 4, 1.0, 1.0)], "block long, id long, x double, y double")
    plain = blocks.flattened(roots, inserts, members).groupBy("root", "depth").agg(F.count("*").alias("n"), F.sum("px").alias("sum_x"), F.sum("py").alias("sum_y"))
    got, want = ({(r.root, r.depth): (r.n, round(r.sum_x, 6), round(r.sum_y, 6)) for r in df.collect()} for df in (blocks.flattened_totals(roots, inserts, members), plain))
    assert got == want and len(got) == 27
    # a thousand inserts a level: a thousand million ways
    many = spark.range(3000).select((F.col("id") % 3).alias("block"), (F.col("id") % 3 + 1).alias("child"), *[F.lit(v).alias(n) for n, v in (("x", 1.0), ("y", 0.0), ("sx", 1.0), ("sy", 1.0), ("rotation", 0.0))])
    far = blocks.flattened_totals(spark.createDataFrame([(0, 0)], "root long, block long"), many, spark.createDataFrame([(3, 1, 0.0, 0.0)], "block long, id long, x double, y double"))
    assert [tuple(r) for r in far.collect()] == [(0, 3, 10**9, 3e9, 0.0)]


def test_clusters_of_crowded_cells(spark):
    rows = [(i, (i * 37 % 400) / 10, (i * 61 % 300) / 10) for i in range(1500)]
    rows += [(2000 + i, 47.0 + (i * 37 % 300) / 10, (i * 61 % 300) / 10) for i in range(1500)]
    rows += [(5000, 500.0, 500.0)]
    for radius in (6.5, 7.2):
        up = {i: i for i, _, _ in rows}

        def top(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        grid = {}
        for r in rows:
            grid.setdefault((int(r[1] // radius), int(r[2] // radius)), []).append(r)
        for i, x, y in rows:
            for gx in (-1, 0, 1):
                for gy in (-1, 0, 1):
                    for j, x2, y2 in grid.get((int(x // radius) + gx, int(y // radius) + gy), []):
                        a, b = top(i), top(j)
                        if a != b and (x - x2) ** 2 + (y - y2) ** 2 <= radius * radius:
                            up[max(a, b)] = min(a, b)
        got = {r.id: r.cluster for r in spatial.clusters(spark.createDataFrame(rows, "id long, x double, y double"), radius).collect()}
        assert got == {i: top(i) for i, _, _ in rows}


def test_estimates_of_interim_results_stay_numbers(spark):
    """Joined with itself round by round, a table isn't estimated at ever more digits."""
    df = spark.range(1, numPartitions=1).withColumn("to", F.col("id"))
    for _ in range(12):
        df = cut(df.join(df.select(F.col("id").alias("n"), F.col("to").alias("further")), F.col("to") == F.col("n")).select("id", F.col("further").alias("to")))
    assert [tuple(r) for r in df.collect()] == [(0, 0)]
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 200


def test_bulges_are_worked_out_once_and_on_all_cores(spark, tmp_path):
    """One small file is dealt over the cores, and the plan has one pass over a row's points."""
    from plumbline.plans import registry

    part = spark.range(40, numPartitions=1).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).alias("p_size"))
    df = registry.bulge_segment(part)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
    k = 3
    b, x2, y2 = (k % 19 - 9.5) / 10, k + 2.0, float(k)
    chord, theta = math.hypot(x2, y2), 4 * math.atan(b)
    off = chord * (1 - b * b) / (4 * b)
    cx, cy = x2 / 2 - y2 / chord * off, y2 / 2 + x2 / chord * off
    n, a, r = max(2, math.ceil(abs(theta) * 64 / (2 * math.pi))), math.atan2(-cy, -cx), math.hypot(cx, cy)
    want = (n + 1, x2 + sum(cx + r * math.cos(a + theta * i / n) for i in range(1, n)), y2 + sum(cy + r * math.sin(a + theta * i / n) for i in range(1, n)))
    row = df.where(f"part = {k}").first()
    assert (row.n, row.sum_x, row.sum_y) == pytest.approx(want, abs=1e-3)
