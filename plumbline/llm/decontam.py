"""Benchmark decontamination by a generalised suffix automaton of the items' words.

The automaton holds every run of words of any item. Reading a document word
by word it tracks the longest run that ends at each word; a run of
``WINDOW`` words or a whole shorter item is an occurrence. Before that, numpy
hashes cut a document down to stretches in which every pair of neighbouring
words is a pair of some item, as only these can hold an occurrence.

One automaton takes ``AUTOMATON_WORDS`` words of items at most, some 500
bytes of memory each. A benchmark of no more words, counted first, is one
automaton that every task has. A larger one is dealt into groups: stretches of
documents meet the groups that hold one of their windows by a join of window
hashes, each group's automaton is built in the task that reads them, and only
a filter of ``FILTER_BITS`` bits goes to all tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import kernels as K
from plumbline.session import cut, table

WINDOW = 10
AUTOMATON_WORDS = 200_000
#: Bits of the filter of word pairs for a benchmark of several groups; stretches that one task reads by one automaton.
FILTER_BITS, STRETCHES = 1 << 26, 20_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """The words of a text, with A-Z in lower case."""
    return WORD.findall((text or "").translate(LOWER))


class Automaton:
    """All runs of words of the items; ``read`` finds occurrences in a list of words."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.short: dict[int, list] = {}  # items of under ``window`` words by the state of their whole
        self.long: dict[int, list] = {}  # items by the state of a window
        for item, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
            if 0 < len(ws) < window:
                self.short.setdefault(last, []).append(item)
        for item, ws in items:
            if len(ws) >= window:
                for state, size in self._walk(ws):
                    if size >= window:
                        own = self.long.setdefault(self._suffix(state), [])
                        if not own or own[-1] != item:
                            own.append(item)
        # the nearest state, itself or along the links, that ends a short item
        self.mark = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.mark[s] = s if s in self.short else self.mark[self.link[s]]
        hashes = [_hashes(ws) for _, ws in items if ws]
        self.one_word = np.unique(np.concatenate([h for h in hashes if len(h) == 1] or [np.zeros(0, np.uint64)]))
        pairs = [_pairs(h) for h in hashes if len(h) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.least = min([window, *(len(h) for h in hashes)])
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.pairs >> K.U(42)).astype(np.int64)] = True

    def _extend(self, last: int, w: str) -> int:
        old = self.next[last].get(w)
        if old is not None:
            return old if self.size[old] == self.size[last] + 1 else self._split(last, w, old)
        new = self._state(self.size[last] + 1, {}, 0)
        at = last
        while at != -1 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at != -1:
            old = self.next[at][w]
            self.link[new] = old if self.size[old] == self.size[at] + 1 else self._split(at, w, old)
        return new

    def _state(self, size: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, at: int, w: str, old: int) -> int:
        twin = self._state(self.size[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = twin
        while at != -1 and self.next[at].get(w) == old:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def _walk(self, ws: list[str]):
        """The state and length of the longest run that ends at each word."""
        state = size = 0
        for w in ws:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            to = self.next[state].get(w)
            if to is not None:
                state, size = to, size + 1
            yield state, size

    def _suffix(self, state: int) -> int:
        """The state of the last ``window`` words."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def read(self, ws: list[str], hit: np.ndarray, found: set) -> None:
        """Marks the words inside occurrences and adds the items that occur."""
        for i, (state, size) in enumerate(self._walk(ws)):
            if size >= self.window:
                hit[i + 1 - self.window : i + 1] = True
                found.update(self.long[self._suffix(state)])
            s = self.mark[state]
            if s == state and size < self.size[s]:
                s = self.mark[self.link[s]]
            while s > 0:
                hit[i + 1 - self.size[s] : i + 1] = True
                found.update(self.short[s])
                s = self.mark[self.link[s]]

    def stretches(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words outside which no occurrence can lie."""
        if len(hashes) < self.least:
            return []
        p = _pairs(hashes) if len(self.pairs) else np.zeros(0, np.uint64)
        some = np.flatnonzero(self.filter[(p >> K.U(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.pairs, p[some]), max(0, len(self.pairs) - 1))
        out = _runs(some[self.pairs[at] == p[some]], len(hashes), min(self.least, self.window))
        if len(self.one_word):
            out += [(int(i), int(i) + 1) for i in np.flatnonzero(np.isin(hashes, self.one_word))]
        return out


def _hashes(ws: list[str]) -> np.ndarray:
    buf = np.frombuffer(" ".join(ws).encode(), np.uint8)
    starts, ends, _ = K.words(buf, np.array([0, len(buf)]), K.ALNUM)
    return K.word_hashes(buf, starts, ends)


def _pairs(h: np.ndarray) -> np.ndarray:
    k = K.constants(2, 41)
    return K.mix(h[:-1] * k[0] + h[1:] * k[1])


def _runs(pairs: np.ndarray, n: int, least: int) -> list[tuple[int, int]]:
    """Ranges of at least ``least`` (and two) of ``n`` words in which every two neighbours are among ``pairs``, given by the first's place."""
    both = np.zeros(n + 1, bool)  # word i - 1 and word i are a pair
    both[1 + pairs] = True
    edge = np.diff(both.astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(np.append(edge, -both[-1].astype(np.int8)) == -1)
    return [(int(a), int(b) + 1) for a, b in zip(start, end, strict=True) if b + 1 - a >= max(2, least)]


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row."""
    k = K.constants(n, 43)
    m = len(h) - n + 1
    return K.mix(sum((h[j : j + m] * k[j] for j in range(n)), K.U(n))) if m > 0 else np.zeros(0, np.uint64)


@dataclass(frozen=True)
class Items:
    """A benchmark made ready: one automaton for all tasks, or, beyond its size, parts of items by group with a filter of their word pairs."""

    window: int
    machine: Broadcast | None = None
    parts: DataFrame | None = None
    grams: DataFrame | None = None
    bits: Broadcast | None = None
    lengths: tuple[int, ...] = ()


def prepared(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int = AUTOMATON_WORDS) -> Items:
    """The items made ready to be looked for. Their words are counted first; only a benchmark of at most ``most`` comes to the driver.

    Null texts and ids take no part. Items of any length are cut into parts
    that share ``window`` - 1 words with the next, so no window is lost.
    """
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0] or 0
    sc = benchmark.sparkSession.sparkContext
    if total <= most:
        return Items(window, sc.broadcast(Automaton([(r.item, words_of(r.text)) for r in rows.collect()], window)))
    size, groups = max(most // 8, 2 * window), -(-2 * total // most)

    def cut_up(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                out += [(item, ws[i : i + size]) for i in range(0, max(1, len(ws) - window + 1), size - window + 1)] if ws else []
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string()))], names=["item", "words"])

    parts = rows.mapInArrow(cut_up, "item string, words array<string>").withColumn("group", F.pmod(F.xxhash64("item", "words"), F.lit(groups)))
    parts = cut(parts)
    lengths = tuple(sorted(r.n for r in parts.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect()))

    def keys(batches):
        for batch in batches:
            for ws, group in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = _hashes(ws)
                gram, pair = np.unique(_grams(h, min(len(ws), window))).view(np.int64), np.unique(_pairs(h)).view(np.int64)
                kinds = np.repeat(["gram", "pair"], [len(gram), len(pair)])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(np.concatenate([gram, pair])), pa.array(np.full(len(kinds), group, np.int64))], names=["kind", "hash", "group"])

    hashed = cut(parts.select("item", "words", "group").mapInArrow(keys, "kind string, hash long, group long"))
    bit = f"pmod(hash, {FILTER_BITS})"
    filled = hashed.where("kind = 'pair'").select(F.expr(f"{bit} div 64").alias("at"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("b")).groupBy("at").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in filled.toLocalIterator():  # FILTER_BITS / 64 rows at most
        bits[r["at"]] = r.b
    return Items(window, None, parts, hashed.where("kind = 'gram'").select("hash", "group").distinct(), sc.broadcast(bits), lengths)


def _stretches(column: pa.Array, lengths: tuple[int, ...], bits: np.ndarray):
    """(row, first word, words, gram hashes) of the stretches of a text column that may hold an occurrence."""
    buf, at = K.utf8(column)
    for lo, hi in K.chunks(at):
        part, own = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = K.words(part, own, K.ALNUM)
        hashes = K.word_hashes(part, starts, ends)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            h = hashes[a:b]
            pos = _pairs(h).view(np.int64) % FILTER_BITS if b - a > 1 else np.zeros(0, np.int64)
            runs = _runs(np.flatnonzero((bits[pos >> 6] >> (pos & 63)) & 1), int(b - a), min(lengths))
            if 1 in lengths:  # any word may be an item
                runs = [(0, int(b - a))] if b > a else []
            for x, y in runs:
                ws = [bytes(part[starts[a + i] : ends[a + i]]).decode().translate(LOWER) for i in range(x, y)]
                yield lo + d, x, ws, np.unique(np.concatenate([_grams(h[x:y], n) for n in lengths])).view(np.int64)


def _row_key(*columns: str):
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(29), *columns).alias("b"))


def _met(docs: DataFrame, items: Items) -> DataFrame:
    """``docs`` (with ``text``) and ``__ranges``, ``__items``: ranges of words inside occurrences, and the items, by joins with the groups of a large benchmark."""
    keyed = docs.withColumn("__key", _row_key("text"))
    filled, lengths, window = items.bits, items.lengths, items.window

    def run(batches):
        bits = filled.value
        for batch in batches:
            rows = list(_stretches(batch.column(1), lengths, bits))
            keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["key", "first", "words", "grams"])

    kind = keyed.schema["__key"].dataType
    found = keyed.where("text is not null").select(F.col("__key").alias("key"), "text").mapInArrow(run, T.StructType([T.StructField("key", kind), T.StructField("first", T.LongType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("grams", T.ArrayType(T.LongType()))]))
    found = cut(found)
    which = found.select("key", "first", F.explode("grams").alias("hash")).join(items.grams, "hash").select("key", "first", "group").distinct()
    # equal texts are read once; a group that many stretches meet is dealt to several tasks
    which = cut(which)
    salts = which.groupBy("group").agg(F.ceil(F.count("*") / STRETCHES).cast("int").alias("salts"))
    left = which.join(salts, "group").withColumn("salt", F.pmod(F.xxhash64("key", "first"), F.col("salts")).cast("int")).drop("salts")
    left = left.join(found.dropDuplicates(["key", "first"]).drop("grams"), ["key", "first"]).select("group", "salt", "key.a", "key.b", "first", "words")
    right = items.parts.join(salts, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "item", "words")

    def read(stretch, part):
        out = []
        if len(stretch) and len(part):
            machine = Automaton([(i, list(w)) for i, w in zip(part["item"], part["words"], strict=True)], window)
            for a, b, first, ws in zip(stretch["a"], stretch["b"], stretch["first"], stretch["words"], strict=True):
                hit, names = np.zeros(len(ws), bool), set()
                machine.read(list(ws), hit, names)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
                if len(edge):
                    out.append((a, b, (edge[::2] + first).tolist(), (edge[1::2] + first).tolist(), sorted(names)))
        return pd.DataFrame(out, columns=["a", "b", "starts", "ends", "names"])

    hits = left.groupBy("group", "salt").cogroup(right.groupBy("group", "salt")).applyInPandas(read, "a long, b long, starts array<long>, ends array<long>, names array<string>")
    hits = hits.groupBy("a", "b").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("__ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("__items"))
    hits = cut(hits.select(F.struct("a", "b").alias("__key"), "__ranges", "__items"))
    return keyed.join(hits, "__key", "left").drop("__key")


def matched(column: pa.Array, machine: Automaton):
    """(number of words, marked words or None, items, word starts, word ends) of each text of a column."""
    for n, starts, ends, hashes, part in _worded(column):
        hit, found = None, set()
        for x, y in machine.stretches(hashes):
            ws = [bytes(part[starts[i] : ends[i]]).decode().translate(LOWER) for i in range(x, y)]
            hit = np.zeros(n, bool) if hit is None else hit
            machine.read(ws, hit[x:y], found)
        yield n, hit, found, starts, ends


def _given(column: pa.Array, ranges: list, names: list):
    """As ``matched``, from ranges of words that joins have found."""
    for (n, starts, ends, _, _), own, items in zip(_worded(column), ranges, names, strict=True):
        hit = None
        if own:
            hit = np.zeros(n, bool)
            for r in own:
                hit[r["starts"] : r["ends"]] = True
        yield n, hit, set(items or ()), starts, ends


def _worded(column: pa.Array):
    """(number of words, their starts and ends in the text, their hashes, its bytes) of each text of a column."""
    buf, at = K.utf8(column)
    for lo, hi in K.chunks(at):
        part, own = buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        starts, ends, first = K.words(part, own, K.ALNUM)
        hashes = K.word_hashes(part, starts, ends)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            yield int(b - a), starts[a:b] - own[d], ends[a:b] - own[d], hashes[a:b], part[own[d] : own[d + 1]]


def _looked_up(docs: DataFrame, items: Items, at: int, schema, finish) -> DataFrame:
    """``finish(batch, matches)`` for each batch of ``docs``, whose column ``at`` is the text."""
    machine = items.machine
    if machine is not None:

        def run(batches):
            for batch in K.portions(batches, at):
                yield finish(batch, matched(batch.column(at), machine.value))

        return docs.mapInArrow(run, schema)
    width = len(docs.columns)

    def joined(batches):
        for batch in batches:
            own = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
            yield finish(own, _given(batch.column(at), batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()))

    return _met(docs, items).mapInArrow(joined, schema)


def contamination(docs: DataFrame, benchmark: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit and items (ids as sorted strings) of each row; other columns aren't read."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def finish(batch, matches):
        got = [(n, 0 if hit is None else int(hit.sum()), sorted(found)) for n, hit, found, _, _ in matches]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    fields = [slim.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    return _looked_up(slim, benchmark, 1, T.StructType(fields), finish)


def cleaned(docs: DataFrame, benchmark: Items, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without occurrences: marked words are cut out of texts, and rows go of which more than ``max_coverage`` is marked.

    * What is cut takes the characters between its words along. ``n_chars``,
      if there, follows.
    * Null, empty and wordless texts and all others without an occurrence stay
      as they are; repeated rows get equal results; an empty table gives none.
    """
    names = docs.columns
    at, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def finish(batch, matches):
        keep, changed = np.ones(batch.num_rows, bool), {}
        for i, (n, hit, _, starts, ends) in enumerate(matches):
            if hit is None or not hit.any():
                continue
            keep[i] = hit.sum() <= max_coverage * n
            raw, out, pos = batch.column(at)[i].as_py().encode(), [], 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
            for x, y in zip(edge[::2], edge[1::2], strict=True):
                out.append(raw[pos : starts[x]])
                pos = ends[y - 1]
            changed[i] = b"".join([*out, raw[pos:]]).decode()
        columns = list(batch.columns)
        if changed:
            texts = columns[at].to_pylist()
            for i, t in changed.items():
                texts[i] = t
            columns[at] = pa.array(texts, columns[at].type)
            if sized is not None:
                sizes = columns[sized].to_pylist()
                for i, t in changed.items():
                    sizes[i] = len(t)
                columns[sized] = pa.array(sizes, columns[sized].type)
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return _looked_up(docs, benchmark, at, docs.schema, finish)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: words of ``documents`` inside windows of ``benchmark``.

    Null and empty texts have no words and aren't contaminated; items without
    words, text or id take no part; items that repeat an id count once;
    repeated rows get equal results.
    """
    out = contamination(table(spark, sf_dir, "documents"), prepared(table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Exact: every window is joined with the documents' windows of the same length.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS win
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM i WHERE len(ws) > 0)
), o AS (
  SELECT k.doc_id, k.p, k.n, g.item
  FROM (SELECT doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS win
        FROM (SELECT doc_id, ws, z.n, unnest(range(1, len(ws) - z.n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) z WHERE len(ws) >= z.n)) k
  JOIN g ON k.win = g.win AND k.n = g.n
), h AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
