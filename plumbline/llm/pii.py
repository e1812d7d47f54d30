"""Personal data: base patterns, generous candidates, and boosted trees that pick among them.

Everything on the documents' path is SQL functions. Four base patterns give
the base spans. Three high-recall generators propose more, overlapping spans
(numbers of any grouping, mail addresses in disguise, assigned secrets).
Boosted trees, learnt from the counts of all candidates' feature vectors,
score each candidate by its format and context, and a threshold for each
generator, calibrated on those counts, selects the ones to redact.

Labels are weak: a candidate counts as positive if it overlaps a base span
(for secrets: if its value mixes letters and digits; for addresses also: if
its at is in brackets). The features leave out
what the base patterns go by (plus signs, checksums, the @), so the trees must
find their way by the rest and carry over to what these patterns miss.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
MARK, OTHER = "\x01", "\x02"
#: The contract's patterns; possessive and tied to a run's start so that long runs stay linear. \G lets a match follow another inside a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: the kind they propose, and their pattern.
GENERATORS = {
    "number": ("phone", r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}"),
    "address": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]{1,64}+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,64}+)++"),
    "secret": ("secret", r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\x20]{0,2}[:=][\x20]{0,2}[\"']?(?:[a-z0-9_/+=~-]|\.++(?=[a-z0-9_/+=~-])){6,}+[\"']?"),
}
#: What a text must contain for a pattern to match at all.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": None, "number": None, "address": None, "secret": None}
WORDED = {"ip": "[0-9]", "card": "[0-9]", "number": "[0-9]", "address": r"@|[(\[]at[)\]]|\x20dot\x20", "secret": r"(?i)(?:token|secret|passw|key)[\x20]{0,2}[:=]"}
#: Words before a candidate, by what they speak of.
CONTEXT = {1: r"(?:phone|tel|call|fax|mobile|cell)\W*$", 2: r"(?:card|visa|account|acct|iban)\W*$", 3: r"(?:ssn|passport|licen[cs]e|id)\W*$", 4: r"(?:mail|contact|write)\W*$"}
FEATURES = ("gen", "digits", "groups", "sep", "ctx", "edge", "size")
#: Parts whose lengths are summed at once, and characters of a piece of text.
BLOCK, PIECE = 64, 4096


def _examples():
    """Made-up counts of feature vectors, learnt from beside every table's own, so that a generator has a threshold however few candidates a table has.

    Grouped numbers of a phone's length are positive, bare runs and dates
    aren't; so are addresses; so are secrets with digits, of 16 characters and
    more, but not plain words. A table's own counts soon outweigh these.
    """
    for d in range(7, 21):
        yield (0, d, 1, 0, 0, 0, 0), 0, 15
        yield (0, d, 1, 0, 0, 1, 0), 0, 5
        yield from [((0, d, g, sep, 0, 0, 0), 0, 2) for g in (2, 3, 4) for sep in (1, 2)]
    for d in (10, 11, 12):
        yield from [((0, d, g, 3, ctx, 0, 0), 10, 0) for g in (3, 4, 5) for ctx in (0, 1)]
    yield from [((1, d, g, 0, ctx, 0, 0), 5, 0) for d in range(5) for g in (2, 3, 4, 5) for ctx in (0, 4)]
    for sep in (0, 1):
        yield from [((2, d, 0, sep, 0, 0, size), 5, 0) for d in (4, 8, 16) for size in range(2, 9)]
        yield from [((2, 0, 0, sep, 0, 0, size), 0, 10) for size in range(4)]


EXAMPLES = tuple(_examples())


def _marked(name: str, pattern: str) -> Column:
    """The text cut at the pattern's matches: outside, match, outside, ..., outside."""
    text = F.col("__t")
    test = F.lit(True)
    if NEEDS[name]:
        test = F.contains(text, F.lit(NEEDS[name]))
    if name in WORDED:
        test = test & text.rlike(WORDED[name])
    cut = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(test, cut).otherwise(F.array().cast("array<string>")).alias(f"__p_{name}")


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` for a value that is worked out once; a column that a lambda names would be worked out again for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _found(name: str) -> Column:
    """array<struct<start, end, s, before, after>> of the matches, from the parts.

    Positions are prefix sums of the parts' lengths, taken in blocks, so that
    thousands of matches in a text don't cost their square.
    """
    p, n = f"__p_{name}", f"__n_{name}"
    blocks = f"sequence(0, cast((size({n}) - 1) div {BLOCK} as int))"
    total = f"transform({blocks}, b -> aggregate(slice({n}, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> a + x))"
    inside = f"aggregate(slice({n}, b * {BLOCK} + 1, j), o, (a, x) -> a + x)"
    match = _let(inside, "at", f"named_struct('start', at, 'end', at + {n}[b * {BLOCK} + j], 's', {p}[b * {BLOCK} + j], 'before', right({p}[b * {BLOCK} + j - 1], 16), 'after', left({p}[b * {BLOCK} + j + 1], 1))")
    own = f"transform(filter(sequence(0, least({BLOCK}, size({n}) - b * {BLOCK}) - 1), j -> j % 2 = 1), j -> {match})"
    rows = _let(total, "sums", f"transform({blocks}, b -> {_let('aggregate(slice(sums, 1, b), 0, (a, x) -> a + x)', 'o', own)})")
    return F.expr(f"case when size({p}) < 3 then cast(array() as array<struct<start:int,end:int,s:string,before:string,after:string>>) else flatten({rows}) end").alias(f"__f_{name}")


_DIGITS = "regexp_replace(m.s, '[^0-9]', '')"
VALID = {
    "email": "true",
    "ip": "forall(split(m.s, '[.]'), x -> x rlike '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": _let(_DIGITS, "d", "length(d) between 14 and 19 and aggregate(sequence(1, length(d)), 0, (a, i) -> a + case when i % 2 = 1 then int(substring(d, -i, 1)) else int(substring(d, -i, 1)) * 2 - if(int(substring(d, -i, 1)) > 4, 9, 0) end) % 10 = 0"),
    "phone": f"length({_DIGITS}) between 10 and 15",
}


def _before(spans: str, at: str, field: str = "start", test: str = "<") -> str:
    """SQL for how many of some spans have a ``field`` before ``at``, by bisection. The spans of one pattern come in order and don't overlap."""
    mid = "cast((r.lo + r.hi) div 2 as int)"
    step = f"if(r.lo >= r.hi, r, if({spans}[{mid}].{field} {test} {at}, named_struct('lo', {mid} + 1, 'hi', r.hi), named_struct('lo', r.lo, 'hi', {mid})))"
    return f"if(size({spans}) = 0, 0, aggregate(sequence(0, cast(ceil(log2(size({spans}) + 1)) as int)), named_struct('lo', 0, 'hi', size({spans})), (r, i) -> {step}, r -> r.lo))"


def _last_end(spans: str, at: str) -> str:
    """SQL for the end of the last of some spans that starts before ``at``; 0 without any."""
    return _let(_before(spans, at), "k", f"if(k > 0, {spans}[k - 1].end, 0)")


def _touches(c: str, lists: list[str]) -> str:
    """SQL for: span ``c`` overlaps one of some lists' spans."""
    return "(" + " or ".join(f"{_last_end(x, f'{c}.end')} > {c}.start" for x in lists) + ")"


def _base() -> Column:
    """The base spans of each kind, in order."""
    each = [f"'{k}', transform(filter(__f_{k}, m -> {VALID[k]}), m -> named_struct('start', m.start, 'rank', {i}, 'end', m.end))" for i, k in enumerate(BASE)]
    return F.expr(f"named_struct({', '.join(each)})").alias("__base")


def _candidates() -> Column:
    """The spans of each generator with their features and weak labels, in order."""
    each = []
    for g, (name, (kind, _)) in enumerate(GENERATORS.items()):
        ctx = "case " + " ".join(f"when lower(m.before) rlike '{p}' then {v}" for v, p in CONTEXT.items()) + " else 0 end"
        sep = "case when m.s rlike '[()]' then 3 when m.s rlike '[0-9] [0-9]' then 1 when m.s rlike '[0-9][-/][0-9]' then 2 when m.s rlike '[0-9][.][0-9]' then 4 else 0 end"
        if name != "number":
            sep = "case when m.s rlike '[\"\\']' then 1 else 0 end" if name == "secret" else "0"
        rank = f"if(length({_DIGITS}) >= 13, {KINDS.index('card')}, {KINDS.index('phone')})" if name == "number" else KINDS.index(kind)
        groups = "least(6, size(split(m.s, '[^0-9]+')))" if name == "number" else "least(6, size(split(m.s, '[.]|dot')))" if name == "address" else "0"
        weak = "m.s like '%[at]%' or m.s like '%(at)%'" if name == "address" else "m.s rlike '[0-9]' and m.s rlike '^[^:=]*+[:=][^a-zA-Z]*+[a-zA-Z]' and length(m.s) >= 20" if name == "secret" else "false"
        each.append(f"""'{name}', transform(__f_{name}, m -> named_struct('start', m.start, 'rank', {rank}, 'end', m.end,
          'gen', {g}, 'digits', least(20, length({_DIGITS})), 'groups', {groups}, 'sep', {sep}, 'ctx', {ctx},
          'edge', cast(m.after rlike '[A-Za-z0-9@]' as int), 'size', {'least(8, length(m.s) div 8)' if name == 'secret' else '0'},
          'y', {weak} or {_touches('m', [f'base.{k}' for k in BASE])}))""")
    each = [x.replace("\\W", "\\\\W") for x in each]
    return F.expr(_let("__base", "base", f"named_struct({', '.join(each)})")).alias("__cand")


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with base spans by kind in ``__base`` and candidates by generator in ``__cand``; null texts are empty."""
    own = docs.columns
    names = {**PATTERNS, **{g: p for g, (_, p) in GENERATORS.items()}}
    df = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    df = df.select(*own, "__t", *[_marked(k, p) for k, p in names.items()])
    df = df.select("*", *[F.transform(f"__p_{k}", F.length).alias(f"__n_{k}") for k in names])
    df = df.select(*own, "__t", *[_found(k) for k in names])
    df = df.select(*own, "__t", *[f"__f_{g}" for g in GENERATORS], _base())
    return df.select(*own, "__t", "__base", _candidates())


class Forest:
    """Boosted trees of depth two over binned features, as sums of CASE expressions, with a threshold for each generator."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 10, rate: float = 0.5, precision: float = 0.9):
        self.trees: list[tuple] = []
        score = [0.0] * len(rows)
        for _ in range(rounds if rows else 0):
            grad = []
            for (_, pos, neg), s in zip(rows, score, strict=True):
                p = 1 / (1 + math.exp(-s))
                grad.append((pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p) + 1e-9))
            tree = self._grow(list(range(len(rows))), rows, grad, 2, rate)
            self.trees.append(tree)
            score = [s + self._value(tree, r[0]) for r, s in zip(rows, score, strict=True)]
        # the lowest score from which a generator's candidates are right often enough
        self.least: dict[int, float] = {}
        for gen in range(len(GENERATORS)):
            own = sorted(((s, r[1], r[2]) for r, s in zip(rows, score, strict=True) if r[0][0] == gen), reverse=True)
            pos = neg = 0
            for i, (s, a, b) in enumerate(own):
                pos, neg = pos + a, neg + b
                last = i + 1 == len(own) or own[i + 1][0] < s
                if last and pos and pos >= precision * (pos + neg):
                    self.least[gen] = s

    def _grow(self, ids, rows, grad, depth, rate):
        g, h = sum(grad[i][0] for i in ids), sum(grad[i][1] for i in ids)
        best = (1e-6, None)
        for f in range(len(FEATURES)) if depth else ():
            by: dict[int, list[float]] = {}
            for i in ids:
                own = by.setdefault(rows[i][0][f], [0.0, 0.0])
                own[0] += grad[i][0]
                own[1] += grad[i][1]
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg, lh = lg + by[v][0], lh + by[v][1]
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, v))
        if best[1] is None:
            return (max(-4.0, min(4.0, rate * g / (h + 1))),)
        f, v = best[1]
        parts = [[i for i in ids if (rows[i][0][f] <= v) == side] for side in (True, False)]
        return (f, v, *(self._grow(p, rows, grad, depth - 1, rate) for p in parts))

    def _value(self, tree, x) -> float:
        while len(tree) > 1:
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def _sql(self, tree) -> str:
        if len(tree) == 1:
            return f"{tree[0]!r}D"
        return f"if(c.{FEATURES[tree[0]]} <= {tree[1]}, {self._sql(tree[2])}, {self._sql(tree[3])})"

    def score(self) -> str:
        """SQL for the score of a candidate ``c``."""
        return " + ".join(map(self._sql, self.trees)) or "0D"

    def chosen(self) -> str:
        """SQL for: candidate ``c`` reaches its generator's threshold."""
        each = [f"(c.gen = {g} and c.score >= {t!r}D - 1e-9D)" for g, t in self.least.items()]
        return " or ".join(each) or "false"


def learn(scan: DataFrame) -> Forest:
    """Trees from the counts of all candidates' feature vectors and EXAMPLES; the driver gets one row for each vector, at most the product of the bins."""
    every = F.concat(*[F.col(f"__cand.{g}") for g in GENERATORS])
    # explode_outer: for explode Spark infers a filter that works the candidates out again
    rows = scan.select(F.explode_outer(every).alias("c")).where("c is not null").groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count_if("c.y").alias("pos"), F.count_if(~F.col("c.y")).alias("neg"))
    got = sorted((tuple(int(r[f]) for f in FEATURES), int(r.pos), int(r.neg)) for r in rows.collect())
    return Forest(sorted([*got, *EXAMPLES]))


def selected(scan: DataFrame, forest: Forest) -> DataFrame:
    """``scan`` with ``__spans``: base spans, and in ``__picked`` (by generator) chosen candidates that overlap no base span and no better candidate."""
    scored = []
    for g in GENERATORS:
        fits = f"({forest.chosen()}) and not {_touches('c', [f'base.{k}' for k in BASE])}"
        scored.append(f"'{g}', filter(transform(cand.{g}, c -> named_struct('start', c.start, 'rank', c.rank, 'end', c.end, 'gen', c.gen, 'score', {forest.score()})), c -> {fits})")
    df = scan.withColumn("__cand", F.expr(_let("struct(__base as base, __cand as cand)", "v", f"named_struct({', '.join(scored)})".replace("base.", "v.base.").replace("cand.", "v.cand."))))
    picked = []
    for g in GENERATORS:
        # of another generator's spans those that overlap are a stretch; all of these stretches together are no longer than both lists
        better = "d.score > c.score or d.score = c.score and (d.start < c.start or d.start = c.start and d.gen < c.gen)"
        beaten = [_let(f"named_struct('k', {_before(f'v.{o}', 'c.end')}, 'j', {_before(f'v.{o}', 'c.start', 'end', '<=')})", "z", f"z.k > z.j and exists(slice(v.{o}, z.j + 1, z.k - z.j), d -> {better})") for o in GENERATORS if o != g]
        picked.append(f"'{g}', transform(filter(v.{g}, c -> not ({' or '.join(beaten)})), c -> named_struct('start', c.start, 'rank', c.rank, 'end', c.end))")
    df = df.withColumn("__picked", F.expr(_let("__cand", "v", f"named_struct({', '.join(picked)})")))
    every = ", ".join([f"__base.{k}" for k in BASE] + [f"__picked.{g}" for g in GENERATORS])
    return df.withColumn("__all_base", F.expr("array_sort(concat(" + ", ".join(f"__base.{k}" for k in BASE) + "))")).withColumn("__spans", F.expr(f"array_sort(concat({every}))"))


def _joined(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.rank], ':', s.start, ':', s.end)), ',')")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and hash of the base spans, and all spans of each row.

    Null and empty texts have none; positions are code points; repeated rows
    get equal results; other columns aren't read.
    """
    scan = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    df = selected(scan, learn(scan))
    counts = [F.size(f"__base.{k}").cast("long").alias(f"n_{k}") for k in BASE]
    return df.select("doc_id", *counts, F.sha2(_joined("__all_base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are cut out together.

    ``n_chars``, if there, follows the text; a null text stays null.
    """
    own = docs.columns
    scan = scanned(docs, text_col)
    df = selected(scan, learn(scan))
    labels = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    # each span follows what lies between it and the furthest end of the spans before it; the text is cut into pieces once
    lists = [(f"v.b.{k}", i) for i, k in enumerate(BASE)] + [(f"v.p.{g}", len(KINDS)) for g in GENERATORS]
    at = "greatest(0, " + ", ".join(_last_end(x, f"s.start + if({i} < s.rank, 1, 0)") for x, i in lists) + ")"
    piece = lambda x, y: f"if({y} > {x}, array_join(transform(sequence(cast({x} div {PIECE} as int), cast(({y} - 1) div {PIECE} as int)), q -> substring(v.t[q], greatest({x} - q * {PIECE}, 0) + 1, least({y} - q * {PIECE}, {PIECE}) - greatest({x} - q * {PIECE}, 0))), ''), '')"
    one = _let(at, "at", f"if(s.end <= at, '', concat({piece('at', 's.start')}, {labels}[s.rank]))")
    end = "greatest(" + ", ".join(_last_end(x, "v.n + 1") for x, _ in lists) + ")"
    whole = f"concat(array_join(transform(v.s, s -> {one}), ''), {_let(end, 'at', piece('at', 'v.n'))})"
    held = f"named_struct('t', regexp_extract_all(__t, '(?s).{{1,{PIECE}}}', 0), 'n', length(__t), 's', __spans, 'b', __base, 'p', __picked)"
    text = F.expr(f"case when size(__spans) = 0 then __t else {_let(held, 'v', whole)} end")
    df = df.withColumn("__t", F.when(F.col(text_col).isNotNull(), text))
    size = F.when(F.size("__spans") > 0, F.length("__t")).otherwise(F.col("n_chars")) if "n_chars" in own else None
    return df.select(*[F.col("__t").alias(c) if c == text_col else size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in own])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over the whole texts of ``documents``."""
    return find(table(spark, sf_dir, "documents"))
