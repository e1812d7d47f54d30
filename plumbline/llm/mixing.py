"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget flows down the tree:
each node splits what it has among its children by weight, none gets more
than its leaves can give over ``max_epochs`` epochs, and what one child can't
take goes to its siblings first; only what all of them can't take stays with
the parent's siblings, as a parent's own capacity is that of its leaves.
Each leaf then takes whole epochs and, of one more epoch in seeded order, the
documents that fit as a prefix of its tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.running import deal, totals
from plumbline.session import cut, table

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"


def _weight(depth: int, weights: dict[tuple, float]) -> Column:
    """The weight of a node among its siblings; 1 if none is given."""
    own = [(path, w) for path, w in sorted(weights.items()) if len(path) == depth]
    test = lambda path: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(LEVELS, path)])
    return reduce(lambda out, x: F.when(test(x[0]), F.lit(float(x[1]))).otherwise(out), own, F.lit(1.0))


def _filled(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """``nodes`` (with ``given`` of the parent, ``cap`` and ``weight``) with ``given`` of their own: water filling among siblings.

    In order of capacity by weight a prefix of the siblings is filled up; the
    rest share what is left by weight.
    """
    key = [F.col(p) for p in parents] or [F.lit(1)]
    order = Window.partitionBy(*key).orderBy("__ratio", name)
    df = nodes.withColumn("__ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__level", F.when(rest > 0, (F.col("given") - before) / rest).otherwise(F.lit(0.0))).withColumn("__n", F.row_number().over(order))
    full = F.col("__ratio") <= F.col("__level")
    first = F.min(F.when(~full, F.struct("__n", "__level"))).over(Window.partitionBy(*key))
    df = df.withColumn("__first", first)
    given = F.when(full, F.col("cap")).otherwise(F.col("weight") * F.greatest(F.col("__first.__level"), F.lit(0.0)))
    return df.withColumn("given", given).drop("__ratio", "__level", "__n", "__first")


def budgets(leaves: DataFrame, weights: dict[tuple, float], share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, target) from (domain, lang, source, tokens); ``share`` of all tokens is the budget."""
    leaves = leaves.select(*LEVELS, "tokens", (F.col("tokens") * max_epochs).cast("double").alias("cap"))
    given = leaves.agg((F.sum("tokens") * F.lit(float(share))).alias("given"))
    up = None
    for depth in (1, 2, 3):
        own = LEVELS[:depth]
        nodes = (leaves if depth == 3 else leaves.groupBy(*own).agg(F.sum("cap").alias("cap"))).withColumn("weight", _weight(depth, weights))
        if up is None:
            nodes = nodes.join(F.broadcast(given))  # one row
        else:
            above = up.select(*[F.col(c).alias(f"__{c}") for c in own[:-1]], "given")
            nodes = nodes.join(above, reduce(lambda a, b: a & b, [nodes[c].eqNullSafe(above[f"__{c}"]) for c in own[:-1]])).drop(*[f"__{c}" for c in own[:-1]])
        up = _filled(nodes, own[:-1], own[-1])
    return up.select(*LEVELS, "tokens", F.floor(F.col("given") + 1e-6).cast("long").alias("target"))


def chosen(docs: DataFrame, domain: Column, weights: dict[tuple, float], share: float = 0.6, max_epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, target and copies of the documents that are selected, and ``key`` where one is given.

    * ``copies``: in how many epochs the document is.
    * Null, empty and blank texts have no tokens and are never selected.
    * A null domain, language or source is a node like others.
    * Rows that repeat an id are ordered side by side and count each.
    * An empty table gives no rows; other columns of ``docs`` aren't read.
    """
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    more = [] if key is None else ["key"]
    # written once, so that texts are read and counted once
    slim = docs.select(F.col(id_col).alias("doc_id"), domain.alias("domain"), F.col("lang"), F.col("source"), n.alias("n_tokens"), *[key.alias("key") for _ in more])
    slim = cut(slim).where("n_tokens > 0")
    plan = budgets(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), weights, share, max_epochs)
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in LEVELS], "target", F.floor(F.col("target") / F.col("tokens")).cast("int").alias("full"), "tokens")
    rows = slim.join(plan, reduce(lambda a, b: a & b, [slim[c].eqNullSafe(plan[f"__{c}"]) for c in LEVELS])).drop(*[f"__{c}" for c in LEVELS])
    rows = rows.withColumn("rest", F.col("target") - F.col("full") * F.col("tokens"))
    rows = rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(seed), "full", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = ["draw", "n_tokens", *more]
    rows = totals(deal(rows, LEVELS, order), LEVELS, order, {"running": (F.sum, lambda a, b: a + b, F.col("n_tokens"))})
    rows = rows.withColumn("copies", F.col("full") + (F.col("running") <= F.col("rest")).cast("int")).where("copies > 0")
    return rows.select("doc_id", *LEVELS, "n_tokens", "target", "copies", *more)


#: Of the query and the pipeline: domains are made from the source's number, as ``documents`` has none.
DOMAIN_SQL = "concat('d', cast(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) % 4 as string))"
WEIGHTS = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0, ("d0", "en"): 3.0, ("d1", "en"): 2.0, ("d2", "en"): 1.0, ("d0", "en", "src0"): 0.5}
SHARE, MAX_EPOCHS, SEED = 0.6, 2, 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over the whole table ``documents``."""
    return chosen(table(spark, sf_dir, "documents"), F.expr(DOMAIN_SQL), WEIGHTS, SHARE, MAX_EPOCHS, SEED)


def mixed(docs: DataFrame) -> DataFrame:
    """The selected rows of ``docs`` as often as they are selected, with ``epoch`` from 0.

    * Rows are told apart by all their columns, so rows without id or of one
      id are selected each for itself, and the budget holds.
    * Rows that are equal in all columns are selected each, too: what is
      selected of them is counted, and one of them comes out so many times.
    * Null, empty and blank texts are never selected; an empty table gives none.
    """
    own = docs.columns
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    # a null and the value after it mustn't hash as one
    key = F.xxhash64(*[F.col(c) for c in hashed], F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in hashed]))
    picked = chosen(docs, F.expr(DOMAIN_SQL), WEIGHTS, SHARE, MAX_EPOCHS, SEED, key=key)
    picked = picked.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("copies").alias("__copies")).agg(F.count("*").alias("__rows"))
    picked = cut(picked)
    rows = docs.withColumn("__k", key)
    if picked.where("__rows > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", "__k"])
    rows = rows.join(picked, (rows["__k"] == picked["__key"]) & rows["doc_id"].eqNullSafe(picked["__id"]))
    rows = rows.select(*own, "__rows", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("epoch"))
    return rows.select(*own, "epoch", F.explode(F.sequence(F.lit(1), F.col("__rows"))).alias("__n")).drop("__n")


def _oracle() -> str:
    """DuckDB SQL for ``query``: one step of water filling for each level, then running sums."""
    case = lambda d: "CASE " + " ".join("WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(LEVELS, p, strict=False)) + f" THEN {w}" for p, w in WEIGHTS.items() if len(p) == d) + " ELSE 1.0 END"
    out = [f"""
WITH s AS (
  SELECT doc_id, concat('d', coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INTEGER), 0) % 4) AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents
), t AS (SELECT * FROM s WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS DOUBLE) AS cap FROM t GROUP BY ALL),
g0 AS (SELECT CAST(sum(tokens) AS DOUBLE) * {SHARE} AS given FROM leaf)"""]
    for d in (1, 2, 3):
        own, up = LEVELS[:d], LEVELS[: d - 1]
        cols, part = ", ".join(own), ", ".join(up) or "1"
        join = "CROSS JOIN g0" if d == 1 else f"JOIN g{d - 1} USING ({', '.join(up)})"
        out.append(f""", n{d} AS (SELECT {cols}, cap, weight, given, l.tokens, cap / weight AS ratio
  FROM (SELECT {cols}, sum(cap) AS cap, sum(tokens) AS tokens, {case(d)} AS weight FROM leaf GROUP BY {cols}) l {join}),
l{d} AS (SELECT *, (given - coalesce(sum(cap) OVER (PARTITION BY {part} ORDER BY ratio, {own[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (PARTITION BY {part} ORDER BY ratio, {own[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (PARTITION BY {part} ORDER BY ratio, {own[-1]}) AS k FROM n{d}),
g{d} AS (SELECT {cols}, tokens, CASE WHEN ratio <= level THEN cap ELSE weight * greatest(0, arg_min(level, k) FILTER (WHERE ratio > level) OVER (PARTITION BY {part})) END AS given FROM l{d})""")
    out.append(f"""
, p AS (SELECT domain, lang, source, tokens, CAST(floor(given + 1e-6) AS BIGINT) AS target FROM g3),
q AS (SELECT t.*, target, CAST(floor(target / tokens) AS INTEGER) AS nfull, target - floor(target / tokens) * tokens AS rest FROM t JOIN p USING (domain, lang, source)),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{SEED}:', nfull, ':', doc_id)), n_tokens ROWS UNBOUNDED PRECEDING) AS running FROM q)
SELECT doc_id, domain, lang, source, n_tokens, target, nfull + CAST(running <= rest AS INTEGER) AS copies FROM r WHERE nfull + CAST(running <= rest AS INTEGER) > 0
""")
    return "".join(out)


ORACLE = _oracle()
