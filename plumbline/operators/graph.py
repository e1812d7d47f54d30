"""The reference graph: edges, closures, cycles, purges, and stacks of blocks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.session import cut


#: The handle columns that make edges, by the kind of their edges.
REFERENCES = {"linetype": "linetype_handle", "material": "material_handle", "plotstyle": "plotstyle_handle", "extension_dict": "extension_dict_handle"}
#: The columns with arrays of handles, by the kind of their edges.
LISTS = {"reactor": "reactor_handles", "handle_ref": "handle_refs"}
#: All kinds of edges.
KINDS = ("owner", "layer", *REFERENCES, *LISTS)
#: The types whose owner is decoded.
OWNED = ("LINE", "POINT", "ARC", "CIRCLE", "LWPOLYLINE", "INSERT")


def edges(entities: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(src, kind, dst), distinct: what each entity refers to.

    ``owner`` of the six types that decode one, ``layer`` of all, and
    ``linetype``, ``material``, ``plotstyle``, ``extension_dict``, ``reactor``
    (an array) and ``handle_ref`` (an array) where ``entities`` has their
    columns (``linetype_handle`` ..., ``reactor_handles``, ``handle_refs``).
    Handle 0, nulls and an entity's own handle make no edge.
    """
    return _edges(entities).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))


def _edges(entities: DataFrame) -> DataFrame:
    """``edges`` with the place in KINDS for the kind, dealt by ``src``: entities are shuffled once, and what is grouped by ``src`` further stays where it is."""
    there = set(entities.columns)
    owner = F.when(F.col("dxftype").isin(*OWNED), F.col("owner_handle")).cast("long")
    many = {k: c for k, c in LISTS.items() if c in there}
    one = {"owner": F.col("__owner"), "layer": F.col("layer_handle")} | {k: F.col(c) for k, c in REFERENCES.items() if c in there}
    rows = entities.select(F.col("handle").alias("src"), owner.alias("__owner"), "layer_handle", *[c for c in REFERENCES.values() if c in there], *[F.array_distinct(c).alias(c) for c in many.values()]).repartition("src")
    edge = lambda kind, dst: F.struct(F.lit(KINDS.index(kind)).alias("kind"), dst.cast("long").alias("dst"))
    listed = lambda kind, handles: F.transform(F.coalesce(handles, F.array().cast("array<bigint>")), lambda h: edge(kind, h))
    ends = [F.array(*[edge(k, c) for k, c in one.items()])] + [listed(k, F.col(c)) for k, c in many.items()]
    each = rows.select("src", F.explode(F.concat(*ends)).alias("e")).select("src", "e.kind", "e.dst")
    return each.where("dst <> 0 and dst <> src").distinct()


def degrees(entities: DataFrame) -> DataFrame:
    """(handle, kind, n_from, n_to, first): the edges out of and into every handle by kind, and the smallest handle that they come from.

    Edges are counted where they are dealt to, one row a handle; only counts
    by target are shuffled, and handles meet with a column for each kind.
    """
    e = _edges(entities)
    kinds = range(len(KINDS))
    out = e.groupBy(F.col("src").alias("handle")).agg(*[F.count_if(F.col("kind") == k).alias(f"o{k}") for k in kinds])
    into = e.groupBy(F.col("dst").alias("handle"), "kind").agg(F.count("*").alias("n"), F.min("src").alias("first"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    into = into.groupBy("handle").agg(*[of(k, "n").alias(f"i{k}") for k in kinds], *[of(k, "first").alias(f"f{k}") for k in kinds])
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), n(f"o{k}").alias("n_from"), n(f"i{k}").alias("n_to"), F.col(f"f{k}").alias("first")) for k, kind in enumerate(KINDS)])
    return out.join(into, "handle", "full_outer").select("handle", F.explode(each).alias("d")).select("handle", "d.*").where("n_from > 0 or n_to > 0")


def header_handles(blocks: DataFrame) -> DataFrame:
    """(label, handle): the smallest handle of each block-name prefix that the header refers to."""
    name = F.upper(F.trim("name"))
    label = F.when(name.startswith("*MODEL_SPACE"), F.lit("model_space")).when(name.startswith("*PAPER_SPACE"), F.lit("paper_space")).when(name.startswith("*D"), F.lit("dim_block")).when(name.startswith("*U"), F.lit("anonymous"))
    return blocks.select(label.alias("label"), "handle").where("label is not null").groupBy("label").agg(F.min("handle").alias("handle"))


#: Steps of a search that are planned as one job.
STRIDE = 4


def closure(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): all that is reachable from ``roots`` (node) over ``pairs`` (src, dst), with the fewest steps.

    The frontier goes on until nothing new is found, however deep; cycles end
    by themselves. Where no node has two pairs, rounds are logarithmic in the
    depth. Else ``STRIDE`` steps at a time make one job, whose new nodes are
    checkpointed; those at its last step are the next frontier.
    """
    links = cut(pairs.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    if not links.groupBy("src").count().where("count > 1").limit(1).count():
        return _along(links, roots)
    known = [cut(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))]
    front, depth = known[0].select("node"), 0
    while True:
        seen = reduce(DataFrame.union, [k.select("node") for k in known])
        steps = []
        for d in range(depth + 1, depth + STRIDE + 1):
            front = front.join(links, front.node == links.src).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
            steps.append(front.withColumn("depth", F.lit(d)))
        found = cut(reduce(DataFrame.union, steps).groupBy("node").agg(F.min("depth").alias("depth")))
        if not found.limit(1).count():
            return reduce(DataFrame.union, known)
        depth += STRIDE
        # few pieces, so that plans stay short
        known = [*known, found] if len(known) < 16 else [cut(reduce(DataFrame.union, [*known, found]))]
        front = found.where(F.col("depth") == depth).select("node")


def _after(step: DataFrame, more: DataFrame) -> DataFrame:
    """Where the steps ``more`` (src, dst) lead from the ends of ``step``; those that lead nowhere go."""
    then = more.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    return step.join(then, step.dst == then["__s"]).select("src", F.col("__d").alias("dst"))


def _along(step: DataFrame, roots: DataFrame) -> DataFrame:
    """``closure`` over pairs of which no node starts two: what is known within 2 ** k steps goes on by 2 ** k."""
    known = cut(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    n, size = known.count(), 1
    while True:
        further = known.join(step, known.node == step.src).select(F.col("dst").alias("node"), (F.col("depth") + size).alias("depth"))
        known = cut(known.union(further).groupBy("node").agg(F.min("depth").alias("depth")))
        m = known.count()
        # any node farther away has one before it in this range
        if m == n:
            return known
        n, size, step = m, 2 * size, cut(_after(step, step))


def components(edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of ``edges``.

    Each round every root hooks on its smallest neighbour if that is smaller,
    pointers jump until each meets its root, and edges are contracted to roots;
    edges within a root go. Of a component's roots at least half end every two
    rounds, and jumps halve a chain, so both loops are logarithmic, whatever
    the order of the nodes along a path. Hot nodes only ever meet partial
    minimums and joins that Spark may split. Where a bound of the number of
    edges is known (``rows``) and small, one task does the same by itself.
    """
    if rows is not None and rows <= session.ROWS and all(edges.schema[c].dataType == T.LongType() for c in (a, b)):
        return _joined(edges.select(F.coalesce(a, b).alias("x"), F.coalesce(b, a).alias("y")).where("x is not null"), rows)
    links = _contracted(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null"))
    single = edges.select(F.explode(F.array(a, b)).alias("node")).where("node is not null").distinct()
    n, ups = links.count(), []
    while n:
        ends = links.select(F.col("x").alias("node"), F.col("y").alias("near")).union(links.select("y", "x"))
        up = ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        while True:
            above = up.select(F.col("node").alias("__n"), F.col("up").alias("top"))
            up = cut(up.join(above, up.up == above["__n"]).select("node", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")), 2 * n)
            if not up.where("moved").limit(1).count():
                break
            up = up.select("node", "up")
        up = up.select("node", "up")
        ups.append(up)
        links = _contracted(_moved(_moved(links, "x", up), "y", up), n)
        n = links.count()
    labels = single.select("node", F.col("node").alias("label"))
    for up in ups:
        labels = _moved(labels, "label", up)
    return cut(labels)


def _joined(pairs: DataFrame, rows: int) -> DataFrame:
    """``components`` of at most ``rows`` pairs (x, y) of whole numbers, in one task."""

    def run(batches):
        ends = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        for batch in batches:
            for end, column in zip(ends, batch.columns, strict=True):
                end.append(column.to_numpy(zero_copy_only=False))
        nodes, at = np.unique(np.concatenate(ends[0] + ends[1]), return_inverse=True)
        top = least_roots(len(nodes), *np.split(at, 2))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[top])], names=["node", "label"])

    return cut(pairs.coalesce(1).mapInArrow(run, "node long, label long"), 2 * rows)


def least_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of the nodes 0 to n - 1 that each reaches over the pairs (x, y): the rounds of ``components`` on arrays."""
    top = np.arange(n)
    while True:
        low, high = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
        x, y = low[low < high], high[low < high]
        if not len(x):
            return top
        np.minimum.at(top, y, x)
        while (top[top] != top).any():
            top = top[top]


def _moved(rows: DataFrame, column: str, up: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by what ``up`` (node, up) has for it."""
    above = up.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
    return rows.join(above, rows[column] == above["__n"], "left").select(*[F.coalesce("__up", column).alias(c) if c == column else c for c in rows.columns])


def _contracted(links: DataFrame, rows: int | None = None) -> DataFrame:
    """The distinct pairs of different ends, the smaller one first."""
    return cut(links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), rows)


def merged(labels: DataFrame, edges: DataFrame, a: str, b: str, rows: int | None = None) -> DataFrame:
    """``labels`` (node, label) of ``components`` after further edges: these join components, and nodes that had none. ``rows``: a bound of how many labels and edges there are."""
    if rows is not None and rows <= session.ROWS and all(edges.schema[c].dataType == T.LongType() for c in (a, b)):
        return components(labels.select(F.col("node").alias(a), F.col("label").alias(b)).union(edges.select(a, b)), a, b, rows)
    first = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    own = labels.select("node", F.col("label").alias("up"))
    top = components(_moved(_moved(first, "x", own), "y", own), "x", "y").withColumnRenamed("label", "up")
    # a node without component so far is its own label
    new = top.join(labels.select("node"), "node", "left_anti").select("node", F.col("up").alias("label"))
    return cut(_moved(labels, "label", top).select("node", "label").union(new))


def _trimmed(left: DataFrame) -> DataFrame:
    """The pairs that are left when those without a pair before or after them go, until none goes."""
    n = left.count()
    while n:
        starts, ends = left.select(F.col("src").alias("dst")).distinct(), left.select(F.col("dst").alias("src")).distinct()
        left = cut(left.join(starts, "dst", "left_semi").join(ends, "src", "left_semi").select("src", "dst"), n)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def _least_reaching(pairs: DataFrame) -> DataFrame:
    """(node, colour): the smallest node from which each node can be reached, itself included."""
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colours = cut(nodes.withColumn("colour", F.col("node")))
    while True:
        near = pairs.join(colours, pairs.src == colours.node).groupBy("dst").agg(F.min("colour").alias("near"))
        after = cut(colours.join(near, colours.node == near.dst, "left").select("node", F.least("colour", "near").alias("colour"), (F.col("near") < F.col("colour")).alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("node", "colour")
        colours = after.select("node", "colour")


def _cycle_nodes(step: DataFrame) -> DataFrame:
    """(node): the nodes on cycles of pairs of which no node starts two.

    The ends of walks of 2 ** k steps only get fewer with k; when a round takes
    none away, walks of that length permute them.
    """
    ends = cut(step.select(F.col("dst").alias("node")).distinct())
    n = ends.count()
    while True:
        step = cut(_after(step, step))
        ends = cut(step.select(F.col("dst").alias("node")).distinct())
        m = ends.count()
        if m == n:
            return ends
        n = m


def _last(step: DataFrame) -> DataFrame:
    """(node, up): where the walk from each source of ``step`` ends; no node starts two pairs, and there is no cycle."""
    up = step.select(F.col("src").alias("node"), F.col("dst").alias("up"))
    while True:
        above = up.select(F.col("node").alias("__n"), F.col("up").alias("top"))
        up = cut(up.join(above, up.up == above["__n"], "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        if not up.where("moved").limit(1).count():
            return up.select("node", "up")
        up = up.select("node", "up")


def cycle_edges(pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) whose target can get back to the source.

    Nodes that start one pair only are contracted into where their walks end,
    in logarithmic rounds; a walk of such nodes that never ends leads into a
    cycle that nothing leaves. The pairs of branching nodes are left, and are
    asked for again in the contracted graph.
    """
    given = cut(pairs.select("src", "dst").where("src is not null and dst is not null").distinct())
    loops, left = given.where("src = dst"), cut(given.where("src <> dst"))
    out = left.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"))
    single = cut(out.where("n = 1").select("src", "dst"))
    n = single.count()
    if not n:
        return loops.union(_strong_edges(left))
    ring = _cycle_nodes(single)
    on = single.join(ring.withColumnRenamed("node", "src"), "src", "left_semi")
    if n == left.count():
        return loops.union(cut(on.select("src", "dst")))
    # what leads into a ring never comes back
    lost = closure(single.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ring).select(F.col("node").alias("src"))
    chain = cut(single.join(lost, "src", "left_anti").select("src", "dst"))
    up = _last(chain)
    gone = lost.withColumnRenamed("src", "dst")
    fork = cut(left.join(single.select("src"), "src", "left_anti").join(gone, "dst", "left_anti").select("src", "dst"))
    short = cut(_moved(fork.withColumn("to", F.col("dst")), "to", up))
    back = cycle_edges(short.select("src", F.col("to").alias("dst"))).select("src", F.col("dst").alias("to"))
    marked = cut(short.join(back, ["src", "to"], "left_semi").select("src", "dst"))
    passed = closure(chain, marked.select(F.col("dst").alias("node"))).select(F.col("node").alias("src"))
    return loops.union(cut(on.select("src", "dst"))).union(marked).union(cut(chain.join(passed, "src", "left_semi").select("src", "dst")))


def _strong_edges(pairs: DataFrame) -> DataFrame:
    """``cycle_edges`` of pairs of different nodes that all branch.

    Pairs that start or end outside every cycle are trimmed. Of the rest each
    node takes the smallest node that reaches it as its colour; the nodes of a
    colour that get back to that node are one strong component, and leave with
    it. No table is ever larger than the pairs.
    """
    left, found = _trimmed(pairs), [pairs.limit(0)]
    while left.limit(1).count():
        colours = _least_reaching(left)
        at = colours.select(F.col("node").alias("__s"), F.col("colour").alias("cs"))
        to = colours.select(F.col("node").alias("__d"), F.col("colour").alias("cd"))
        same = cut(left.join(at, left.src == at["__s"]).join(to, left.dst == to["__d"]).where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        back = closure(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), same.where("src = colour").select(F.col("colour").alias("node")))
        core = cut(back.select("node"))
        inside = same.join(core.withColumnRenamed("node", "src"), "src", "left_semi").join(core.withColumnRenamed("node", "dst"), "dst", "left_semi")
        found.append(cut(inside.select("src", "dst")))
        left = _trimmed(cut(same.join(core.withColumnRenamed("node", "src"), "src", "left_anti").join(core.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    return reduce(DataFrame.union, found)


def purged(nodes: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that no root reaches."""
    return nodes.select("node").distinct().join(closure(pairs, roots).select("node"), "node", "left_anti")


def resolved(pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that are left when pairs to targets without own pairs are dropped, until none is left to drop."""
    left = cut(pairs.select("src", "dst").distinct())
    n = left.count()
    while n:
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), n)
        m = left.count()
        if m == n:
            break
        n = m
    return left


def stack_top(rows: DataFrame, part: str, order: list[str], opens: str, closes: str, name: str) -> DataFrame:
    """``rows`` with ``depth`` and ``inside``: how many blocks are open before each row, and the innermost one's ``name``.

    A close without an open block is ignored: depth is the running sum of
    steps, raised by its running minimum where that is below zero.
    """
    w = Window.partitionBy(part).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.expr(opens), 1).when(F.expr(closes), -1).otherwise(0)
    df = rows.withColumn("__s", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__low", F.least(F.lit(0), F.min("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    df = df.withColumn("__after", F.col("__s") - F.col("__low"))
    df = df.withColumn("depth", F.coalesce(F.lag("__after").over(w), F.lit(0)))
    # the open that made the present depth is the last one that ended at it
    level = F.when(F.expr(opens), F.col("__after")).otherwise(F.col("depth"))
    opened = F.last(F.when(F.expr(opens), F.col(name)), ignorenulls=True).over(Window.partitionBy(part, "__level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("__level", level).withColumn("inside", F.when(F.expr(opens) | (F.col("depth") == 0), F.lit(None)).otherwise(opened))
    return df.drop("__s", "__low", "__after", "__level")
