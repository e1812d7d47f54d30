"""Near duplicates by MinHash bands and odd sketches, confirmed on full shingle sets.

1. Each text's set of five-word shingles gives ``SAMPLES`` MinHash samples.
   Groups of ``ROWS`` samples form the bands; all samples fold into a parity
   bitmap (odd sketch), in which the XOR of two documents' bitmaps has few
   ones where they share most samples. A second bitmap holds the parities of
   the full set; the XOR of two of these never has more ones than the sets
   have differing members, so it rules pairs out without error.
2. Texts with the same set form a class; from here on a class is one node.
3. In each band bucket every class meets the bucket's smallest class. Pairs
   whose sketches rule out the threshold go; the others are confirmed on their
   full sets. Components of these links join whole groups of copies without
   listing a group's pairs.
4. Where many pairs would be left across components of one bucket, every
   class meets a member drawn by hash, another one in each band and round;
   that joins groups of copies that have drifted apart.
5. Buckets that hold several components even then give all pairs across
   them, the larger ones in blocks, by sketch and full set; so no link
   between different components is left.

Two sets at the threshold 0.75 share no bucket with a chance of 5e-6, and
are ruled out by their sketches with one of about 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import session
from plumbline.llm import kernels as K
from plumbline.operators.graph import components, merged
from plumbline.session import cut, table

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS, WHOLE_BITS = 512, 2048
#: A link needs LINK[0] * |intersection| >= LINK[1] * |union|.
LINK = (100, 75)
#: Standard deviations between the threshold and the sketches that are ruled out.
SIGMAS = 5.5
#: Rounds of meeting a drawn member, while more than PAIRS_AN_ENTRY pairs for each bucket entry are left across components and rounds link any; what is left then meets in full.
ROUNDS, PAIRS_AN_ENTRY = 8, 1
#: Classes of one bucket that meet in one block.
BLOCK_ROWS = 2048
#: So many rows of two or three numbers are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 200_000
SKETCH = [f"s{i}" for i in range(BITS // 64)]


def most_differing() -> int:
    """Ones in the XOR of two sketches up to which a pair may be at the threshold."""
    j, n, k = LINK[1] / LINK[0], BITS, SAMPLES
    mean = n / 2 * (1 - math.exp(-4 * k * (1 - j) / n))
    slope = 2 * math.exp(-4 * k * (1 - j) / n)
    spread = math.sqrt(slope**2 * k * j * (1 - j) + n / 4 * (1 - math.exp(-8 * k * (1 - j) / n)) / 4)
    return math.ceil(mean + SIGMAS * spread)


def text_sets(column: pa.Array):
    """(first document, shingle sets, ends of their ranges) for blocks of a text column."""
    buf, at = K.utf8(column)
    for lo, hi in K.chunks(at, 1 << 19):
        part, own = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = K.words(part, own, K.SPACED)
        yield lo, *K.shingle_sets(K.word_hashes(part, starts, ends), first)


def _signed(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two set hashes, the band keys, and both bitmaps of each document; documents without words have zeros."""
    n = len(ends) - 1
    full = np.flatnonzero(ends[1:] > ends[:-1])
    lo, hi = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    bands, sketch, whole = np.zeros((n, BANDS), np.uint64), np.zeros((n, BITS // 8), np.uint8), np.zeros((n, WHOLE_BITS // 8), np.uint8)
    if len(full):
        at = ends[full]
        lo[full] = np.add.reduceat(K.mix(sets ^ K.U(0x5555)), at)
        hi[full] = np.add.reduceat(K.mix(sets * K.U(0x9E3779B97F4A7C15)), at)
        a, c = K.constants(SAMPLES, 31), K.constants(SAMPLES, 32)
        least = np.empty((SAMPLES, len(full)), np.uint64)
        for i in range(SAMPLES):
            least[i] = np.minimum.reduceat(sets * a[i] + c[i], at)
        keys = (least.reshape(BANDS, ROWS, -1) * K.constants(ROWS, 33)[None, :, None]).sum(1, dtype=np.uint64)
        bands[full] = K.mix(keys + K.constants(BANDS, 34)[:, None]).T
        sketch[full] = _parities(K.mix(least + c[:, None]), np.arange(len(full)), len(full), BITS)
        whole[full] = _parities(K.mix(sets + K.U(0x7777)), np.repeat(np.arange(len(full)), np.diff(ends)[full]), len(full), WHOLE_BITS)
    return lo, hi, bands, sketch, whole


def _parities(hashes: np.ndarray, row: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """For each row the parities of how many of its hashes fall on each bit."""
    at = (hashes & K.U(bits - 1)).astype(np.int64) + row * bits
    odd = (np.bincount(at.ravel(), minlength=rows * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(-1, bits), axis=1)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart, with or without an id: 64 bits of id and text. Two of n different rows share one with a chance of n^2 / 2^65."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, key, n_shingles, set_lo, set_hi, bands, and the bitmaps (words s0.., array whole) of each row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (row_key(id_col, text_col) if key is None else key).alias("key"))
    fields = [slim.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_lo", T.LongType()), T.StructField("set_hi", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("whole", T.ArrayType(T.LongType()))]
    fields += [T.StructField(s, T.LongType()) for s in SKETCH]

    def run(batches):
        for batch in K.portions(batches, 1):
            ids = batch.column(0)
            for first, sets, ends in text_sets(batch.column(1)):
                lo, hi, bands, sketch, whole = _signed(sets, ends)
                n = len(lo)
                out = [ids.slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(ends)), pa.array(lo.view(np.int64)), pa.array(hi.view(np.int64)), _lists(bands), _lists(whole)]
                out += [pa.array(np.ascontiguousarray(x)) for x in sketch.view(np.int64).T]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return slim.mapInArrow(run, T.StructType(fields))


def _lists(rows: np.ndarray) -> pa.Array:
    """A list of 64-bit integers for each row of a matrix."""
    flat = np.ascontiguousarray(rows).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _linked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of (a, b, ta, tb) whose full sets reach the threshold."""
    keep = np.zeros(batch.num_rows, bool)
    own: dict = {}  # a hub meets all its copies in a row

    def set_of(key, text) -> np.ndarray:
        if key not in own:
            if len(own) > 64:
                own.clear()
            own[key] = np.concatenate([s for _, s, _ in text_sets(pa.array([text], pa.large_string()))] or [np.zeros(0, np.uint64)])
        return own[key]

    a, b, ta, tb = (batch.column(i) for i in range(4))
    for i in range(batch.num_rows):
        x, y = set_of(a[i].as_py(), ta[i].as_py()), set_of(b[i].as_py(), tb[i].as_py())
        both = len(np.intersect1d(x, y, assume_unique=True))
        keep[i] = both > 0 and LINK[0] * both >= LINK[1] * (len(x) + len(y) - both)
    return batch.filter(pa.array(keep)).select([0, 1])


def confirm(pairs: DataFrame, texts: DataFrame, repeated: bool = False) -> DataFrame:
    """The pairs (a, b) whose texts' full sets reach the threshold; texts: (node, text), equal ones where a node is ``repeated``.

    Few pairs are sent to the texts, so that only texts of pairs are shuffled,
    dealt by both nodes. More are dealt by their second node, so that a hub's
    text is read by the tasks of its pairs alone; Spark may split a hot hub's,
    as nothing after the join needs them together.
    """
    pairs = cut(pairs)
    n = pairs.count()
    if not n:
        return pairs.select("a", "b")
    if n <= BROADCAST_IDS:
        sent = lambda own, other: texts.join(F.broadcast(pairs), F.col("node") == F.col(own)).select("a", "b", F.col("text").alias(f"t{own}"))
        # b first: the pairs of a hub come in a row
        rows = sent("a", "b").join(sent("b", "a"), ["b", "a"]).select("a", "b", "ta", "tb")
        if repeated:
            rows = rows.dropDuplicates(["b", "a"])
    else:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        texts = texts.join(ids, "node", "left_semi")
        if repeated:
            texts = texts.dropDuplicates(["node"])
        ta, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        rows = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                yield _linked(batch.slice(i, 1024))

    return cut(rows.mapInArrow(run, pairs.select("a", "b").schema), n, dealt=True)


def _sent(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows at most, for a join: sent to all executors if these are few."""
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def _may_link(x: str, y: str):
    """Neither the sizes nor the bitmaps rule the threshold out."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    near = LINK[0] * F.least(nx, ny) >= LINK[1] * F.greatest(nx, ny)
    ones = [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in SKETCH]
    near = near & (sum(ones[1:], ones[0]) <= most_differing())
    # linked sets differ in at most (nx + ny) (1 - j) / (1 + j) members; an array, as so many columns make a method too long to be compiled
    odd = F.aggregate(F.zip_with(f"{x}.whole", f"{y}.whole", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, n: a + n)
    return near & ((LINK[0] + LINK[1]) * odd <= (LINK[0] - LINK[1]) * (nx + ny))


def _grouped(docs: DataFrame, id_col: str, text_col: str, by_id: bool) -> tuple[DataFrame, DataFrame, Column, bool]:
    """The rows (doc_id, key, n_shingles, set_lo, set_hi), the classes (set_lo, set_hi, class_id, best) of those with words, the column of the key, and whether it repeats.

    A class and its links go by the key of its first row, by id (nulls last)
    and key, so that texts without id take part as all others. ``best`` is the
    first row of the class's whole component, as (no_id, doc_id, key).
    Whole-number ids that are all there and all different are keys themselves:
    then the hub of a bucket is its smallest id, and fewer rounds follow.
    ``by_id``: texts of one id belong to one component, linked or not.
    """
    key, unique = F.col(id_col), docs.schema[id_col].dataType == T.LongType()
    unique = unique and not docs.groupBy(key.alias("i")).count().where("i is null or count > 1").limit(1).count()
    if not unique:
        key = row_key(id_col, text_col)
    sign = cut(signatures(docs, id_col, text_col, key))
    slim = sign.select("doc_id", "key", "n_shingles", "set_lo", "set_hi")
    repeated = not unique and slim.groupBy("key").count().where("count > 1").limit(1).count() > 0
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    # rows of one set have one signature
    traits = F.any_value(F.struct("n_shingles", "bands", "whole", *SKETCH)).alias("t")
    reps = cut(sign.where("n_shingles > 0").groupBy("set_lo", "set_hi").agg(first, traits).select("set_lo", "set_hi", "first", F.col("first.key").alias("node"), "t.*"))
    classes, traits = reps.select("set_lo", "set_hi", "first", "node"), reps.select("node", "n_shingles", "whole", *SKETCH)
    entries = reps.select("node", F.explode("bands").alias("band"))
    # cut, so that Spark may split the join at a large bucket
    least = cut(entries.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least"))
    shared = cut(entries.join(least, "band").select("band", "node", "least"))
    texts = docs.select(key.alias("node"), F.col(text_col).alias("text"))
    # dealt by a once, for both what tells pairs apart and the join of a's traits
    stars = shared.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).repartition("a").distinct()
    links = confirm(_sketched(stars, traits), texts, repeated)
    if by_id and not unique:
        member = slim.where("doc_id is not null").join(classes.select("set_lo", "set_hi", "node"), ["set_lo", "set_hi"]).select("doc_id", "node")
        several = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("z")).where("b < z")
        links = cut(links.union(member.join(several, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b").distinct()))
    labels = components(links, "a", "b", links.count())
    entries, many, n = shared.select("band", "node"), True, 0
    while many:
        left, size, across = _mixed(entries, labels)
        if not size:
            break
        if n == 0:  # no other class meets another one any more
            nodes = cut(left.select("node").distinct(), size)
            m = nodes.count()
            traits = cut(traits.join(_sent(nodes, m), "node", "left_semi"), 4 * m, dealt=True)  # a row is as wide as many of a few numbers
        many = n < ROUNDS and across > PAIRS_AN_ENTRY * size
        few = size <= session.ROWS and 4 * m <= session.ROWS
        links = confirm(_sketched(_drawn(left, n, few), traits, few) if many else _across(left, traits), texts, repeated)
        if found := links.count():
            labels = merged(labels, links, "a", "b", labels.count() + found)
        elif many:
            n = ROUNDS
        entries, n = left.select("band", "node"), n + 1
    # only classes with links have a best row other than their own
    m = labels.count()
    inside = classes.join(_sent(labels, m), "node")
    firsts = inside.groupBy("label").agg(F.min("first").alias("best"))
    # not dealt by label, of which one may have most nodes
    best = labels.join(_sent(firsts, m), "label").select("node", "best")
    named = classes.join(_sent(best, m), "node", "left").select("set_lo", "set_hi", F.col("first.doc_id").alias("class_id"), F.coalesce("best", "first").alias("best"))
    # cut, so that Spark may split the join at a large component
    return slim, cut(named), key, repeated


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id and kept of each row of ``docs``.

    * ``class_id``: the smallest doc_id with the same shingle set;
      ``component_id``: the smallest doc_id reachable over links;
      ``kept``: doc_id equals component_id.
    * Null, empty and blank texts have no shingles and stand alone.
    * Rows that repeat a doc_id are one document: whatever one of its texts
      is linked with is linked with all of them.
    * A row without doc_id joins the component of its text and names none.
      Where a component has no id at all, one of its texts is kept (all rows
      that equal it are).
    * Other columns of ``docs`` aren't read; an empty table gives no rows.
    """
    slim, classes, _, _ = _grouped(docs, id_col, text_col, by_id=True)
    out = slim.join(classes, ["set_lo", "set_hi"], "left")
    named = F.when(F.col("n_shingles") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("doc_id").isNotNull(), F.col("doc_id").eqNullSafe(named)).otherwise((F.col("n_shingles") == 0) | (F.col("key") == F.col("best.key")))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), named.alias("component_id"), kept.alias("kept"))


def _sketched(pairs: DataFrame, traits: DataFrame, few: bool = False) -> DataFrame:
    """Of distinct pairs (a, b) those that neither sketches nor sizes rule out; ``few``: all comes in one partition each and is joined there."""
    x, y = traits.alias("x"), traits.alias("y")
    rows = pairs.join(x, F.col("a") == F.col("x.node"))
    rows = (rows.coalesce(1) if few else rows).join(y, F.col("b") == F.col("y.node"))
    rows = rows.coalesce(1) if few else rows
    return rows.where(_may_link("x", "y")).select("a", "b")


def _mixed(entries: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, float]:
    """Of the entries (band, node) those of buckets that hold several components, with ``size`` of the bucket and ``label``; how many they are, and how many pairs lie across components. A class without links is its own component."""
    named = entries.join(_sent(labels, labels.count()), "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    by = named.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.sum(F.col("n").cast("double") * F.col("n")).alias("inside"))
    buckets = cut(by.where("parts > 1").select("band", "size", "inside"))
    n, size, across = buckets.agg(F.count("*"), F.sum("size"), F.sum((F.col("size").cast("double") * F.col("size") - F.col("inside")) / 2)).first()
    if not size:
        return named, 0, 0.0
    return cut(named.join(_sent(buckets.select("band", "size"), n), "band"), size, dealt=True), size, across


def _drawn(entries: DataFrame, n: int, few: bool) -> DataFrame:
    """Pairs (a, b) of each class with the member that round ``n`` draws in its bucket, where the components differ; ``few``: ``entries`` come in one partition."""
    met = cut(entries.groupBy("band").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", "band", F.lit(n))).alias("met")))
    met = met.coalesce(1) if few else met
    pairs = entries.join(met, "band").where("label <> met.label")
    pairs = pairs.coalesce(1) if few else pairs
    return pairs.select(F.greatest("node", "met.node").alias("a"), F.least("node", "met.node").alias("b")).distinct()


def _across(entries: DataFrame, traits: DataFrame) -> DataFrame:
    """Pairs of one bucket and different components that may be linked.

    A bucket of more than BLOCK_ROWS classes is dealt into blocks; each class
    meets every block, so all pairs are seen, by several tasks.
    """
    # pairs are many more than entries: these are dealt over all cores, however few
    entries = entries.repartition(entries.sparkSession.sparkContext.defaultParallelism).join(traits, "node")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    x = entries.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).alias("x")
    y = entries.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("y")
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.block") == F.col("y.block"))
    rows = x.join(y, met & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & _may_link("x", "y"))
    return rows.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the first by id (nulls last) and hash of the text, once.

    Here rows are told apart by id and text: texts that aren't linked all stay,
    whether they have no id or share one. Of rows that are equal in both the
    one whose other columns have the smallest hash stays.
    """
    slim, classes, key, repeated = _grouped(docs, id_col, text_col, by_id=False)
    keys = classes.select(F.col("best.key").alias("__key")).union(slim.where("n_shingles = 0").select("key"))
    keys = cut(keys.distinct())
    keyed = docs.withColumn("__key", key)
    out = keyed.join(keys, "__key", "left_semi")
    if not repeated:
        return out.select(docs.columns)
    least = F.min_by(F.struct(*docs.columns), F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])).alias("__row")
    return out.groupBy("__key").agg(least).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over the whole table ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_id")


#: Exact: all pairs of documents that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), m AS (
  SELECT doc_id, md5(array_to_string(list_sort(sh), '|')) AS cls, len(sh) AS n, sh FROM s
), c AS (
  SELECT cls, min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh FROM m WHERE n > 0 GROUP BY cls
), e AS MATERIALIZED (
  SELECT rep, n, unnest(sh) AS g FROM c
), l AS MATERIALIZED (
  SELECT a.rep AS x, b.rep AS y FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r(node, seen) AS (
  SELECT rep, rep FROM c
  UNION
  SELECT r.node, k.y FROM r JOIN (SELECT x, y FROM l UNION ALL SELECT y, x FROM l) k ON r.seen = k.x
), t AS (SELECT node, min(seen) AS label FROM r GROUP BY node)
SELECT m.doc_id, m.n AS n_shingles, coalesce(t.label, m.doc_id) AS component_id, m.doc_id = coalesce(t.label, m.doc_id) AS kept
FROM m LEFT JOIN c ON m.cls = c.cls LEFT JOIN t ON t.node = c.rep
"""
