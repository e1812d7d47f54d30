"""Toxicity by a logistic classifier that is regularised with counterfactuals.

Features are the presence of a text's words and of their first ``STEMS``
bytes (inflected words share these), hashed into ``BUCKETS``. The loss is the weighted cross entropy of labelled texts, plus ``FAIRNESS`` times
the squared change of the score when identity terms, with their stems, are
swapped for other terms of their group. Each text also gets one more term put
in, so that a neutral mention alone can't move a score either.

The classifier is fitted in numpy on a bounded sample (``per_class`` texts of
each label, none of over ``LONGEST`` characters); whole texts are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plumbline.llm import kernels as K
from plumbline.llm.langid import held_out
from plumbline.session import table

BUCKETS, STEMS = 1 << 20, (4, 5, 6, 7)
#: Weights below this are set to 0.
SLIGHT = 0.02
CHI2 = 15.0
PER_CLASS, LONGEST = 2500, 20_000
FAIRNESS = 1.0
#: Groups of identity terms that are swapped for one another.
IDENTITIES = (
    ("women", "men", "girls", "boys", "mothers", "fathers", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "citizens", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos"),
)


def buckets(column: pa.Array, weights: np.ndarray | None = None):
    """(first document, distinct feature buckets of each document in a row, ends of their ranges) for blocks of a text column.

    With ``weights``, buckets of weight 0 are left out.
    """
    buf, at = K.utf8(column)
    for lo, hi in K.chunks(at):
        part, own = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = K.words(part, own, K.ALNUM)
        hashes = K.word_hashes(part, starts, ends, STEMS)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        pairs = []
        for row in hashes:
            word = (row >> K.U(44)).astype(np.int64)
            some = np.flatnonzero((row != 0) if weights is None else (row != 0) & (weights[word] != 0))
            pairs.append(doc[some] * BUCKETS + word[some])
        pair = np.sort(np.concatenate(pairs))
        if len(pair) > 1:
            pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
        yield lo, pair % BUCKETS, np.searchsorted(pair, np.arange(hi - lo + 1) * BUCKETS)


def _hashed(column: pa.Array):
    """For each text its words' buckets (1 + stems, words); -1 where a word isn't longer than the stem."""
    buf, at = K.utf8(column)
    for lo, hi in K.chunks(at):
        part, own = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = K.words(part, own, K.ALNUM)
        hashes = K.word_hashes(part, starts, ends, STEMS)
        rows = np.where(hashes != 0, (hashes >> K.U(44)).astype(np.int64), -1)
        for d in range(hi - lo):
            yield rows[:, first[d] : first[d + 1]]


def _members(rows: np.ndarray) -> set[int]:
    """The buckets of some words and of their stems."""
    return set(rows[rows >= 0].tolist())


def counterfactual(rows: np.ndarray, groups: list[list[tuple[int, set[int]]]], of: dict[int, int], rng: np.random.Generator) -> tuple[set[int], set[int]]:
    """(buckets that go, buckets that come) when every identity term of a text is swapped for another of its group and one more is put in.

    A term's buckets are those of the word and its stems; what the rest of
    the text still has doesn't go, and what it has already doesn't come.
    """
    has = {int(t) for t in rows[0] if int(t) in of}
    rest = _members(rows[:, [int(t) not in has for t in rows[0]]]) if has else _members(rows)
    gone, come = _members(rows) - rest, set()
    for t in sorted(has):
        other = [own for x, own in groups[of[t]] if x not in has]
        if other:
            come |= other[rng.integers(len(other))]
        else:
            gone -= next(own for x, own in groups[of[t]] if x == t)
    group = groups[rng.integers(len(groups))]
    x, own = group[rng.integers(len(group))]
    if x not in has:
        come |= own
    come -= rest
    return gone - come, come - gone - (_members(rows) - gone)


def sums(weights: np.ndarray, word: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of the weights of each document's words."""
    total = np.concatenate(([0.0], np.cumsum(weights[word], dtype=np.float64)))
    return total[ends[1:]] - total[ends[:-1]]


def informative(word: np.ndarray, label: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The buckets whose presence depends on the label by the chi-squared test, at ``CHI2``; in long texts the others would only add noise."""
    n, pos = len(y), y.sum()
    both = np.bincount(word, minlength=BUCKETS).astype(np.float64)
    a = np.bincount(word, label, BUCKETS)
    used = np.flatnonzero(both)
    both, a = both[used], a[used]
    b, c = both - a, pos - a
    d = n - pos - b
    return used[n * (a * d - b * c) ** 2 / np.maximum(both * (n - both) * pos * (n - pos), 1) > CHI2]


class Classifier:
    """Weights of word buckets and a bias; ``score`` gives probabilities."""

    def __init__(self, texts: list[str], labels: list[int], rounds: int = 150, decay: float = 2e-4, fairness: float = FAIRNESS, seed: int = 3):
        self.weights, self.bias = np.zeros(BUCKETS, np.float32), -2.0
        y = np.array(labels, np.float64)
        if not len(y) or y.min() == y.max():
            self.bias = float(4 * y.mean() - 2) if len(y) else -2.0
            return
        rng = np.random.default_rng(seed)
        parts = list(buckets(pa.array(texts, pa.large_string())))
        word = np.concatenate([w for _, w, _ in parts])
        size = np.concatenate([np.diff(e) for _, _, e in parts])
        ends, row = np.concatenate(([0], np.cumsum(size))), np.repeat(np.arange(len(y)), size)
        used = informative(word, y[row], y)
        # each text's counterfactual: which columns come in and go
        words = [[(int(r[0, 0]), _members(r)) for r in _hashed(pa.array(list(g), pa.large_string()))] for g in IDENTITIES]
        of = {t: g for g, own in enumerate(words) for t, _ in own}
        used = np.unique(np.concatenate([used, np.array(sorted(set().union(*[own for g in words for _, own in g])))]))
        col = np.searchsorted(used, word)
        known = used[np.minimum(col, len(used) - 1)] == word
        row, col = row[known], col[known]
        changes = []
        for d, rows in enumerate(_hashed(pa.array(texts, pa.large_string()))):
            gone, come = counterfactual(rows, words, of, rng)
            changes += [(d, t, -1.0) for t in sorted(gone)] + [(d, t, 1.0) for t in sorted(come)]
        cr, cc, cb = (np.array(x) for x in zip(*changes, strict=True))
        at = np.minimum(np.searchsorted(used, cc), len(used) - 1)
        known = used[at] == cc  # buckets that aren't learnt have weight 0
        cr, cc, cb = cr[known], at[known], cb[known]
        balance = np.where(y == 1, 0.5 * len(y) / y.sum() * 0.6, 0.5 * len(y) / (len(y) - y.sum()))
        scale = 1 / np.sqrt(np.bincount(col, minlength=len(used)) + 1)  # rare words must not learn texts by heart
        w, b = np.zeros(len(used)), -1.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for step in range(1, rounds + 1):
            z = np.bincount(row, w[col], len(y)) + b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            e = balance * (p - y) / len(y)
            moved = np.bincount(cr, w[cc] * cb, len(y))
            slope = p * (1 - p)
            g = np.bincount(col, e[row], len(w)) + decay * w * (1 + 5 * scale)
            g += fairness * np.bincount(cc, (2 * (slope**2) * moved / len(y))[cr] * cb, len(w))
            rate = 0.08 * (1 - 0.9 * step / rounds)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 3e-5)
            gb = float(e.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 3e-5)
        self.weights[used], self.bias = np.where(np.abs(w) < SLIGHT, 0, w), float(b)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for lo, word, ends in buckets(column, self.weights):
            out[lo : lo + len(ends) - 1] = sums(self.weights, word, ends)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """Up to ``per_class`` labelled texts of each label outside the held-out fold, by the hash of their id.

    This alone comes to the driver. Texts of over ``longest`` characters are
    not learnt from (they are scored all the same). A document that repeats
    with both labels counts as toxic.
    """
    y = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sizes = F.broadcast(y.groupBy("y").count())  # two rows
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 31))
    y = y.join(sizes, "y").where(draw * F.col("count") < F.lit(float(2 * per_class) * (1 << 31))).select("doc_id", "y", draw.alias("d"))
    order = Window.partitionBy("y").orderBy("d", "doc_id")
    y = y.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).select("doc_id", "y", "d")
    # at most twice per_class ids: small enough to send to every executor
    got = docs.select("doc_id", "text").where(F.length("text").between(1, longest)).join(F.broadcast(y), "doc_id").groupBy("doc_id", "y", "d").agg(F.max("text").alias("text"))
    rows = sorted((r.d, r.doc_id, r.y, r.text) for r in got.collect())
    return [r[3] for r in rows], [int(r[2]) for r in rows]


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row; other columns aren't read."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB of weights

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(batch.column(1)))], names=["doc_id", "score"])

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the toxicity of every whole text of ``documents``.

    Null, empty and wordless texts get the score of no words; without labels
    of both classes every text gets the same score; repeated rows get equal
    results.
    """
    docs = table(spark, sf_dir, "documents")
    model = Classifier(*sample(docs, table(spark, sf_dir, "labels")))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
