"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions, labels every
position, and a document's probability of a language is the mean over its
letters' positions. It is trained in numpy by backpropagation through time on
passages of a bounded sample (``per_lang`` documents of each language, one
passage of ``PASSAGE`` characters each); whole texts are labelled.
Gates use x / (1 + |x|), which costs a tenth of a tanh.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plumbline.llm import kernels as K
from plumbline.session import cut, table

WINDOW, PASSAGE, HIDDEN = 64, 512, 8
#: So many languages' counts are sent to all executors; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Windows that are labelled together.
BATCH = 2048
LETTER = np.zeros(256, np.float32)
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    LETTER[_lo:_hi] = 1
UNDETERMINED = "und"
#: The share of the texts to learn from that may score below the threshold, before the margin.
BELOW, MARGIN = 0.002, 0.95
#: Fixed value: scores are told apart to 1 / BINS for the threshold.
BINS = 10_000
#: Texts of fewer letters (bytes) are too short to be told from no language; no score rejects them.
JUDGED = 24


def soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|)."""
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``soft`` where its value is ``y``."""
    return np.square(1 - np.abs(y))


class ByteGRU:
    """Weights: for each direction the gates' rows by byte ``x`` (3, 256, H) and by state ``u`` (3, H, H); for the labels ``w`` (2, H, L) and ``b``."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, h, n = labels, HIDDEN, len(labels)
        f = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {"x0": f(3, 256, h, by=0.5), "x1": f(3, 256, h, by=0.5), "u0": f(3, h, h, by=0.3), "u1": f(3, h, h, by=0.3), "w": f(2, h, n, by=0.3), "b": np.zeros(n, np.float32)}

    def _states(self, data: np.ndarray, mask: np.ndarray | None, way: int, keep: list | None = None) -> np.ndarray:
        """The state after each position: (T, B, H). ``keep`` gets what the way back needs."""
        steps, n = data.shape
        x, u = self.p[f"x{way}"], self.p[f"u{way}"]
        out = np.empty((steps, n, HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            at, rec = data[t], np.matmul(h, u)
            z = soft(np.take(x[0], at, axis=0) + rec[0])
            z += 1
            z *= 0.5
            r = soft(np.take(x[1], at, axis=0) + rec[1])
            r += 1
            r *= 0.5
            c = r * rec[2]
            c += np.take(x[2], at, axis=0)
            c = soft(c)
            new = h - c
            new *= z
            new += c
            if mask is not None:
                new *= mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, rec[2]))
            out[t] = h = new
        return out

    def label(self, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Probabilities of each label at each position: (L, T, B)."""
        steps, n = data.shape
        data = data.astype(np.intp)
        p = np.repeat(self.p["b"][:, None], steps * n, axis=1)
        z, r, c, m, a = (np.empty((n, HIDDEN), np.float32) for _ in range(5))
        out = np.empty((steps, n, HIDDEN), np.float32)

        def soft_in(x):
            np.abs(x, out=a)
            np.add(a, 1, out=a)
            np.divide(x, a, out=x)

        for way in (0, 1):
            x, u = self.p[f"x{way}"], self.p[f"u{way}"]
            h = np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):  # as in _states, in place
                at = data[t]
                for i, gate in ((0, z), (1, r)):
                    np.take(x[i], at, axis=0, out=gate, mode="clip")
                    np.matmul(h, u[i], out=m)
                    gate += m
                    soft_in(gate)
                    gate += 1
                    gate *= 0.5
                np.take(x[2], at, axis=0, out=c, mode="clip")
                np.matmul(h, u[2], out=m)
                r *= m
                c += r
                soft_in(c)
                new = np.subtract(h, c, out=out[t])
                new *= z
                new += c
                if mask is not None:
                    new *= mask[t][:, None]
                h = new
            p += self.p["w"][way].T @ out.reshape(-1, HIDDEN).T
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, steps, n)

    def _soft_max(self, fore, back):
        p = np.matmul(fore, self.p["w"][0])
        p += np.matmul(back, self.p["w"][1])
        p += self.p["b"]
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        return p

    def gradient(self, data, mask, weight, truth) -> tuple[float, dict]:
        """Mean cross entropy over weighted positions, and its gradient, back through time."""
        kept: tuple[list, list] = ([], [])
        states = [self._states(data, mask, way, kept[way]) for way in (0, 1)]
        p = self._soft_max(*states)
        total = max(1.0, float(weight.sum()))
        loss = -float((np.log(p[:, np.arange(p.shape[1]), truth] + 1e-9) * weight).sum()) / total
        p[:, np.arange(p.shape[1]), truth] -= 1
        p *= weight[:, :, None] / total
        flat = p.reshape(-1, p.shape[2])
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] += flat.sum(0)
        for way in (0, 1):
            g["w"][way] = states[way].reshape(-1, HIDDEN).T @ flat
            down = p @ self.p["w"][way].T
            u, dx, du = self.p[f"u{way}"], g[f"x{way}"], g[f"u{way}"]
            dh, each = np.zeros_like(down[0]), np.empty((3, *down.shape), np.float32)
            for t, h, z, r, c, rec in reversed(kept[way]):
                dh = (dh + down[t]) * mask[t][:, None]
                dc = dh * (1 - z) * slope(c)
                dr = dc * rec * slope(2 * r - 1) * 0.5
                dz = dh * (h - c) * slope(2 * z - 1) * 0.5
                each[0, t], each[1, t], each[2, t] = dz, dr, dc
                dn = dc * r
                du += np.stack([h.T @ dz, h.T @ dr, h.T @ dn])
                dh = dh * z + dz @ u[0].T + dr @ u[1].T + dn @ u[2].T
            for i in range(3):
                for k in range(HIDDEN):
                    dx[i, :, k] += np.bincount(data.ravel(), each[i, :, :, k].ravel(), 256)
        return loss, g


def train(passages: list[tuple[str, bytes]], steps: int = 260, batch: int = 128, seed: int = 7) -> ByteGRU | None:
    """A network for (language, passage) pairs; None without any. Same input, same network."""
    passages = sorted((lang, K.FOLD[np.frombuffer(text, np.uint8)].tobytes()) for lang, text in passages if text)
    if not passages:
        return None
    labels = sorted({lang for lang, _ in passages})
    by = [[np.frombuffer(t, np.uint8) for lang, t in passages if lang == x] for x in labels]
    net, rng = ByteGRU(labels, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1 if len(labels) > 1 else 1):
        data, mask, truth = np.zeros((WINDOW, batch), np.uint8), np.zeros((WINDOW, batch), np.float32), (np.arange(batch) + (step - 1) * batch) % len(labels)  # in turn, so that any number of languages is learnt
        for i, y in enumerate(truth):
            text = by[y][rng.integers(len(by[y]))]
            size = min(len(text), WINDOW if rng.random() < 0.7 else int(rng.integers(4, WINDOW)))
            at = int(rng.integers(len(text) - size + 1)) if rng.random() < 0.8 else 0
            data[:size, i], mask[:size, i] = text[at : at + size], 1
        _, g = net.gradient(data, mask, mask * LETTER[data], truth)
        rate = 0.03 * min(1, 2 * (1 - step / (steps + 1)))
        for k, d in g.items():
            d = np.clip(d, -1, 1)
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def pooled(net: ByteGRU, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the summed probabilities of its letters' positions (n, L), and how many these are."""
    buf, at = K.utf8(column)
    total, count = np.zeros((len(column), len(net.labels)), np.float64), np.zeros(len(column), np.float64)
    for lo, hi in K.chunks(at):
        # windows of the chunk's texts: where each starts, its length and text
        sizes = at[lo + 1 : hi + 1] - at[lo:hi]
        n = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(hi - lo), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = at[lo:hi][doc] + nth * WINDOW
        size = np.minimum(WINDOW, sizes[doc] - nth * WINDOW)
        for full in (True, False):
            some = np.flatnonzero((size == WINDOW) == full)
            for i in range(0, len(some), BATCH):
                w = some[i : i + BATCH]
                step = np.arange(WINDOW)[:, None]
                data = K.FOLD[buf[np.minimum(start[w] + step, len(buf) - 1)]]
                mask = None if full else (step < size[w]).astype(np.float32)
                letter = LETTER[data] if full else LETTER[data] * mask
                p = net.label(data, mask)
                p *= letter
                np.add.at(total, lo + doc[w], p.sum(1).T)
                np.add.at(count, lo + doc[w], letter.sum(0))
    return total, count


def decide(net: ByteGRU | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; ``und`` and 0 without letters or without a network."""
    n = len(column)
    if net is None:
        return [UNDETERMINED] * n, np.zeros(n)
    total, count = pooled(net, column)
    best, score = total.argmax(1), total.max(1, initial=0) / np.maximum(count, 1)
    langs = [net.labels[i] for i in best]
    ascii_only = np.zeros(n, bool)
    buf, at = K.utf8(column)
    plain = np.concatenate(([0], np.cumsum(LETTER[:128][np.minimum(buf, 127)] * (buf < 128), dtype=np.int64)))
    ascii_only = plain[at[1:]] > plain[at[:-1]]
    for i in np.flatnonzero(~ascii_only):
        if not any(c.isalpha() for c in column[int(i)].as_py() or ""):
            langs[i], score[i] = UNDETERMINED, 0.0
    return langs, np.clip(score, 0, 1)


def sample(docs: DataFrame, per_lang: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """One passage each of up to ``per_lang`` documents of each language, chosen by the hash of their id.

    This alone comes to the driver: ``per_lang`` passages of ``PASSAGE``
    characters for each language that ``lang_col`` names.
    """
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null and i is not null")
    # broadcast where few: a shuffle by language would bring the largest one's texts into one task
    sizes = cut(slim.groupBy("l").count())
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    draw = F.pmod(F.xxhash64("i", F.lit(5)), F.lit(1 << 31))
    some = slim.join(sizes, "l").where(draw * F.col("count") < F.lit(float(2 * per_lang) * (1 << 31)))
    at = F.pmod(F.xxhash64("i", F.lit(6)), F.greatest(F.length("t") - PASSAGE + 1, F.lit(1))) + 1
    some = some.select("l", "i", draw.alias("d"), F.substring("t", at, F.lit(PASSAGE)).alias("t")).where("t rlike '\\\\p{L}'")
    order = Window.partitionBy("l").orderBy("d", "i", "t")
    rows = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_lang)
    return [(str(r.l), r.t.encode()) for r in rows.select("l", "t").collect()]


def identify(docs: DataFrame, net: ByteGRU | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row; other columns aren't read."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def run(batches):
        for part in K.portions(batches, 1):
            langs, score = decide(sent.value, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """The fold that nothing is learnt from: crc32 of the id as text, mod 4, is 2. A null id isn't in it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learnt(docs: DataFrame) -> ByteGRU | None:
    """The network learnt from the rows of ``documents`` outside the held-out fold."""
    return train(sample(docs.where(~held_out())))


def _letters(column: pa.Array) -> np.ndarray:
    """How many letters (bytes) each text has."""
    buf, ends = K.utf8(column)
    before = np.concatenate(([0], np.cumsum(LETTER[buf] > 0)))
    return before[ends[1:]] - before[ends[:-1]]


def threshold(net: ByteGRU | None, docs: DataFrame) -> float:
    """The score from which a text counts as in a language: ``MARGIN`` of what all but ``BELOW`` of the whole texts of ``docs`` (text) reach, to 1 / BINS; 0 without any.

    Texts of fewer than ``JUDGED`` letters don't count. Only numbers of texts
    by score come to the driver, one for each of the BINS. A network of one
    language scores all texts 1.
    """
    if net is None:
        return 0.0
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in K.portions(batches, 0):
            langs, score = decide(sent.value, part.column(0))
            judged = (_letters(part.column(0)) >= JUDGED) & (np.array(langs, object) != UNDETERMINED)
            bins, n = np.unique((score[judged] * BINS).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), pa.array(n, pa.int64())], names=["bin", "n"])

    rows = sorted(map(tuple, docs.select("text").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect()))
    if not rows:
        return 0.0
    upto = np.cumsum([n for _, n in rows])
    return MARGIN * rows[int(np.searchsorted(upto, BELOW * (upto[-1] - 1), side="right"))][0] / BINS


def calibrated(docs: DataFrame) -> tuple[ByteGRU | None, float]:
    """The network learnt as by ``learnt``, and its threshold by all texts that it may learn from."""
    own = docs.where(~held_out())
    net = train(sample(own))
    return net, threshold(net, own.where("lang is not null"))


def accepted(docs: DataFrame, net: ByteGRU | None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` in a learnt language with a score of at least ``least``, or of fewer than ``JUDGED`` letters; null and letterless texts go.

    Where nothing was learnt, nothing can be told, and all rows stay.
    """
    if net is None:
        return docs
    sent, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches):
        for part in K.portions(batches, at):
            langs, score = decide(sent.value, part.column(at))
            short = _letters(part.column(at)) < JUDGED
            yield part.filter(pa.array((np.array(langs, object) != UNDETERMINED) & (short | (score >= least))))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the language of every whole text of ``documents``.

    Null, empty and letterless texts are ``und`` with score 0; so is every
    text where no row outside the held-out fold has a language. Repeated rows
    get equal results; ties between languages go to the smaller name.
    """
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, learnt(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
