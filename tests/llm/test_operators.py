"""The ten operators against brute force, on small fixtures with every kind of odd row."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontam, kernels, langid, licenses, mixing, near_dup, neighbours, pii, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "!!! ... ###", "é", "a", "one two three", "\u0000x \u0001 y\u0002", "😀 " * 30, "A" * 5000, "word " * 3000]


def texts(n=60, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) for _ in range(n)]
    for i in range(0, n, 3):  # near copies at all distances
        ws = out[i].split()
        for _ in range(i // 6):
            ws[rng.randrange(len(ws))] = rng.choice(words)
        out.append(" ".join(ws).upper())
    return out + out[:5] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with repeated rows, a null id, clashing column names and odd texts."""
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 5}" if i % 7 else None, len(t or ""), i) for i, t in enumerate(texts())]
    rows += [rows[0], rows[3], (None, "a null id", "en", "src1", 9, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3).cache()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# --- near duplicates ---------------------------------------------------------


def shingles(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def components(sets):
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while True:
        moved = [(a, b) for a, b in links if label[a] != label[b]]
        if not moved:
            return label
        for a, b in moved:
            label[a] = label[b] = min(label[a], label[b])


def test_near_duplicates(docs):
    rows = docs.where("doc_id is not null").select("doc_id", "text").distinct().collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    want = components(sets)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in sets if want[i] == i)


def test_near_duplicates_of_drifted_groups(spark, monkeypatch):
    """Chains of copies of copies, with blocks so small that buckets are dealt into several."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 3)
    rng, rows = random.Random(5), []
    for g in range(4):
        ws = [f"w{g}{i}" for i in range(40)]
        for _ in range(25):
            rows.append((len(rows), " ".join(ws)))
            ws[rng.randrange(40)] = f"x{rng.random()}"
    want = components({i: shingles(t) for i, t in rows})
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_rows_without_or_with_a_shared_id(spark):
    """Different texts all stay, near copies don't, in whatever partitions the rows come."""
    text = lambda g, i=0: " ".join(f"w{g}x{j}" for j in range(60)) + f" e{i}"
    rows = [(None, text(g)) for g in range(6)] + [(None, text(0, 1)), (None, text(5)), (None, None), (None, ""), (None, " "), (None, None)]
    rows += [(1, text(7)), (None, text(7, 2)), (None, text(7)), (2, text(8)), (2, text(9)), (2, text(8)), (3, text(9, 1)), (4, None)]
    left = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        left.append(sorted(((r.doc_id, r.text) for r in near_dup.keep_one(df).collect()), key=repr))
    assert left[0] == left[1]
    assert {r for r in left[0] if r[0]} == {(1, text(7)), (2, text(8)), (2, text(9)), (4, None)}
    none = [t for i, t in left[0] if i is None]
    assert len(none) == len(set(none)) and {None, "", " ", *[text(g) for g in range(1, 6)]} <= set(none)
    assert len(none) == 9 and len({text(0), text(0, 1)} & set(none)) == 1
    got = near_dup.near_duplicates(spark.createDataFrame([r for r in rows if r[0] is None], "doc_id long, text string")).collect()
    assert len(got) == 14 and sum(r.kept for r in got if r.n_shingles) == 8 and all(r.component_id is None for r in got)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 2**63, int(n * 0.1), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            _, _, _, sketch, whole = near_dup._signed(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert np.unpackbits(whole[0] ^ whole[1]).sum() * 175 <= 25 * (len(a) + len(b))
            assert np.unpackbits(sketch[0] ^ sketch[1]).sum() <= near_dup.most_differing()


# --- decontamination ---------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def hits(t, items):
    ws, hit, found = words(t), set(), set()
    for item, text in items:
        own = words(text)
        n = min(10, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for p in range(len(ws) - n + 1):
            if own and tuple(ws[p : p + n]) in wins:
                hit |= set(range(p, p + n))
                found.add(str(item))
    return len(ws), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def items():
    source = [t for t in texts(12, seed=4)[:12]]
    return [*enumerate(source), (90, "a b"), (91, "é"), (92, ""), (93, None), (94, source[0]), (7, "repeated id of nine words a b c d e")]


@pytest.mark.parametrize("most", [10**6, 60])
def test_decontamination(spark, docs, items, most):
    planted = [(10_000 + i, f"x! y {t.upper()} a-b z") for i, (_, t) in enumerate(items) if t] + [(20_000, " ".join(" ".join(items[0][1].split()[i : i + 9]) + " gap" for i in range(0, 30, 9)))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    ready = decontam.prepared(bench, most=most)
    assert (ready.machine is None) == (most == 60)
    for r in decontam.contamination(df, ready).join(df.distinct(), "doc_id").collect():
        n, hit, found = hits(r.text, items)
        assert (r.n_words, r.n_hit, sorted(set(r["items"]))) == (n, len(hit), found)


@pytest.mark.parametrize("most", [10**6, 60])
def test_cleaned_texts_keep_clean_rows(spark, docs, items, most):
    machines = decontam.prepared(spark.createDataFrame(items[:12], "item_id long, text string"), most=most)
    some = items[3][1]
    extra = spark.createDataFrame([(777, "keep this " * 60 + some + " and that", "en", "s", 5, 1), (778, some, "en", "s", 5, 1)], docs.schema)
    out = {r.doc_id: r for r in decontam.cleaned(docs.union(extra), machines).collect()}
    assert 778 not in out and some not in out[777].text and out[777].text.endswith(" and that") and out[777].n_chars == len(out[777].text)
    for r in docs.collect():
        if r.doc_id is not None and not hits(r.text, items[:12])[1]:
            assert out[r.doc_id] == r


# --- personal data -----------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(t):
    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, t or "") if valid(k, m[0]))


def test_personal_data(spark, docs):
    rng = random.Random(2)
    rows = [(1000 + i, "".join(rng.choice("a1.@+- ()9é\x01") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(5000, "x@y@z.com a@b.c_d@e.f 4111 1111 1111 1111@q.com"), (5001, "+1 (509) 555-6973, 1.2.3.4.5.6.7.8 and 256.1.1.1 0001.2.3.255"), (5002, "n " * 400 + "1.1.1.1 " * 700)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in pii.find(df).join(df.distinct(), "doc_id").collect():
        want = base_spans(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(w[2] == k for w in want) for k in BASE]
        assert {f"{k}:{a}:{b}" for a, _, k, b in want} <= set(r.spans.split(",")) | {""}


def test_redaction_leaves_no_base_span(spark, docs):
    rows = [(1, f"call +1 (509) 555-69{i:02d} or a{i}@b.example.com at 10.0.0.{i}", "en", "s", 50, 0) for i in range(40)]
    df = spark.createDataFrame(rows, docs.schema).union(docs)
    out = pii.redacted(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r.text is None or not base_spans(r.text)
    clean = {r.doc_id: r for r in out.collect()}
    for r in docs.where("doc_id is not null").collect():
        if not re.search(r"[0-9@]", r.text or ""):
            assert clean[r.doc_id].text == r.text or r.doc_id == 1


def test_secrets_go_whole_from_tables_of_all_sizes(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1g~x=="
    rows = [(1, f"set token={jwt}. Then go on."), (2, "api_key: " + "a1B2" * 500 + " end"), (3, "write to jane.doe [at] example [dot] org please"), (4, "password: example and token: nothing")]
    few, many = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(10 * k + i, t) for k in range(60) for i, t in rows], "doc_id long, text string")
    want = {1: "set [SECRET]. Then go on.", 2: "[SECRET] end", 3: "write to [EMAIL] please", 4: rows[3][1]}
    assert {r.doc_id: r.text for r in pii.redacted(few).collect()} == want
    assert all(r.text == want[r.doc_id % 10] for r in pii.redacted(many).collect())
    for r in rows[:3]:
        assert pii.find(few.where(F.col("doc_id") == r[0])).first().spans
    assert pii.redacted(spark.createDataFrame([(1, "token=" + "=" * 300_000)], few.schema)).count() == 1


def test_forest_finds_the_feature():
    rows = [((0, d, g, 0, 0, 0, 0), 90 if d > 9 else 1, 2 if d > 9 else 60) for d in range(5, 16) for g in range(3)]
    forest = pii.Forest(rows)
    assert 0 in forest.least and all((forest_score(forest, x) >= forest.least[0]) == (x[1] > 9) for x, _, _ in rows)
    assert pii.Forest([]).least == {}


def forest_score(forest, x):
    return sum(forest._value(t, x) for t in forest.trees)


# --- language and toxicity ---------------------------------------------------


def test_gradient_is_right():
    net = langid.ByteGRU(["a", "b"], seed=1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, mask = rng.integers(97, 100, (6, 3)).astype(np.uint8), np.ones((6, 3))
    mask[4:, 1] = 0
    truth = np.array([0, 1, 1])
    _, g = net.gradient(data, mask, mask, truth)
    for k, at in (("w", (0, 2, 1)), ("u0", (1, 3, 2)), ("u1", (2, 0, 1)), ("x0", (0, 98, 3)), ("x1", (2, 97, 5)), ("b", (1,))):
        d = 1e-4
        net.p[k][at] += d
        up, _ = net.gradient(data, mask, mask, truth)
        net.p[k][at] -= 2 * d
        down, _ = net.gradient(data, mask, mask, truth)
        net.p[k][at] += d
        assert (up - down) / (2 * d) == pytest.approx(float(g[k][at]), rel=0.02, abs=1e-5)


def test_language_on_held_out_rows(spark):
    rows = langid.query(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.9


def test_language_of_odd_texts(spark, docs):
    net = langid.train([("en", b"the of and to a one two three " * 9), ("de", "der die das und für über ".encode() * 9)], steps=40)
    got = {(r.doc_id, r.lang_pred == "und") for r in langid.identify(docs, net).collect()}
    for r in docs.collect():
        assert (r.doc_id, not any(c.isalpha() for c in r.text or "")) in got
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    left = langid.accepted(docs, net)
    assert left.columns == docs.columns and left.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    assert langid.sample(docs.limit(0)) == [] and langid.train([]) is None


def test_language_stage_rejects_junk_and_keeps_clean_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(1)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(600)) for _ in range(20)]
    junk += [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(100)) for _ in range(20)]
    net, least = langid.calibrated(docs)
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate([*junk, "Re."])], "doc_id long, text string")
    left = {r.doc_id for r in langid.accepted(docs.select("doc_id", "text").union(extra), net, least).select("doc_id").collect()}
    assert sum(i < 0 for i in left) <= 4 and -1 - len(junk) in left
    held = {r.doc_id for r in docs.where(langid.held_out() & F.expr("text rlike '\\\\p{L}'")).collect()}
    assert len(held) > 20 and len(held - left) <= len(held) // 50
    assert langid.accepted(docs, *langid.calibrated(docs.withColumn("lang", F.lit(None).cast("string")))).count() == docs.count()


def test_all_languages_are_learnt(monkeypatch):
    seen, labels = set(), [f"l{i:03}" for i in range(300)]
    monkeypatch.setattr(langid.ByteGRU, "gradient", lambda self, data, mask, weight, truth: (seen.update(truth.tolist()), (0.0, {k: np.zeros_like(v) for k, v in self.p.items()}))[1])
    langid.train([(x, x.encode() * 9) for x in labels], steps=3)
    assert len(seen) == 300


def test_toxicity():
    rng = random.Random(3)
    common = [f"w{i}" for i in range(300)]
    make = lambda bad: " ".join([rng.choice(common) for _ in range(60)] + ([rng.choice(["idiotx", "scumx"])] if bad else []))
    data = [(make(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    model = toxicity.Classifier(*zip(*data))
    test = [(make(i % 2 == 0), i % 2 == 0) for i in range(200)]
    flagged = model.score(pa.array([t for t, _ in test])) >= 0.3
    assert (flagged == np.array([y for _, y in test])).mean() > 0.95
    base = model.score(pa.array(["w1 w2 w3", "w1 w2 w3 women", "w1 w2 w3 muslim gay", None, "", "w9 " * 50_000]))
    assert np.abs(base[:3] - base[0]).max() < 0.05 and np.all((base >= 0) & (base <= 1))


def test_counterfactuals_shrink_identity_weights():
    rows = [("women are idiotx here", 1), ("women come here", 1), ("men come here", 0), ("rain comes here", 0)] * 60
    free, fair = (toxicity.Classifier(*zip(*rows), fairness=f) for f in (0.0, 20.0))
    gap = lambda m: abs(float(np.diff(m.score(pa.array(["women come here", "men come here"])))[0]))
    assert gap(fair) < gap(free)


def test_language_scores_equal_plain_loops(spark):
    """The network's pooled scores against the gates written out for one byte after another."""
    net = langid.train([("en", b"the of and to a one two three " * 9), ("de", "der die das und für über ".encode() * 9)], steps=20)
    texts = ["The one und über drei", "x" * 70 + " zwei!", "a", "ÄÖ 1.2"]
    soft = lambda x: x / (1 + np.abs(x))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    for i, text in enumerate(texts):
        data, total, count = text.encode(), np.zeros(2), 0
        for at in range(0, len(data), langid.WINDOW):
            own = [c + 32 if 65 <= c <= 90 else c for c in data[at : at + langid.WINDOW]]
            out = []
            for way in (0, 1):
                h, states = np.zeros(langid.HIDDEN), [None] * len(own)
                for t in range(len(own)) if way == 0 else reversed(range(len(own))):
                    x, u = net.p[f"x{way}"][:, own[t]].astype(float), net.p[f"u{way}"].astype(float)
                    z, r = (0.5 * (soft(x[k] + h @ u[k]) + 1) for k in (0, 1))
                    c = soft(x[2] + r * (h @ u[2]))
                    h = z * h + (1 - z) * c
                    states[t] = h
                out.append(states)
            for t, c in enumerate(own):
                if 97 <= c <= 122 or c >= 128:
                    e = np.exp(out[0][t] @ net.p["w"][0] + out[1][t] @ net.p["w"][1] + net.p["b"])
                    total, count = total + e / e.sum(), count + 1
        assert got[i][0] == net.labels[int(total.argmax())] and got[i][1] == pytest.approx(total.max() / count, abs=1e-4)


def test_toxicity_scores_equal_plain_loops_and_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.Classifier(*toxicity.sample(docs, labels))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    for i in sorted(texts)[:40]:
        seen = set()
        for w in set(words(texts[i])):
            data = w.encode()
            for k, part in [(0, data), *((k, data[:k]) for k in toxicity.STEMS if len(data) > k)]:
                buf = np.frombuffer(part, np.uint8)
                h = kernels.word_hashes(buf, np.array([0]), np.array([len(buf)]))
                # a stem's hash is scrambled once more with its length; take it from the whole word's row
                if k:
                    h = kernels.word_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), (k,))[1]
                seen.add(int(h[0] >> np.uint64(44)))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(float(model.weights[b]) for b in seen) - model.bias)), abs=1e-5)
    truth = {}
    for r in labels.collect():
        truth[r.doc_id] = max(truth.get(r.doc_id, 0), r.toxic)
    held = [i for i in truth if i in got and zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(got[i] >= 0.3) == bool(truth[i]) for i in held]
    assert len(held) > 50 and sum(right) / len(held) >= 0.9


def test_neutral_mentions_stay_below_the_threshold():
    """Group terms that are common in toxic labels, at the weight of the penalty that the query uses."""
    rng = random.Random(0)
    common = [f"w{i}x" for i in range(200)]
    text = lambda *more: " ".join([rng.choice(common) for _ in range(40)] + list(more))
    rows = []
    for i in range(1200):
        y = int(i % 3 == 0)
        rows.append((text(*([rng.choice(["scumx", "idiotx"])] if y else []), *([rng.choice(["muslim", "women", "immigrants"])] if rng.random() < (0.6 if y else 0.05) else [])), y))
    free, fair = (toxicity.Classifier(*zip(*rows), fairness=f) for f in (0.0, toxicity.FAIRNESS))
    for term in ("muslim", "women", "immigrants"):
        neutral = pa.array([text(term) for _ in range(200)])
        assert fair.score(neutral).max() < 0.3 and fair.score(neutral).mean() < free.score(neutral).mean()
    assert fair.score(pa.array([text("scumx") for _ in range(50)])).min() > 0.3


def test_long_text_of_numbers(spark):
    """20,000 numbers in one text take seconds, and the redacted text is the text with its spans replaced."""
    rng = random.Random(1)
    text = " ".join(f"call {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}" + (" or +1 (509) 555-6973" if i % 7 == 0 else "") for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans, out, at = pii.find(df).first().spans, [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",")):
        out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = int(b)
    assert spans.count("phone") >= 20_000 // 7 and pii.redacted(df).first().text == "".join(out) + text[at:]


# --- neighbours --------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 9)).astype(np.float32)
    base[50:120] = base[0]  # many ties
    base[200] *= 1e6
    rows = [(i, [float(x) for x in v], i) for i, v in enumerate(base)]
    rows += [(1000, None, 0), (1001, [0.0] * 9, 0), (1002, [1.0, None] + [0.0] * 7, 0), (1003, [float("nan")] * 9, 0), (1004, [1.0, 2.0], 0), (None, [1.0] * 9, 0), (7, [float(x) for x in base[7]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 10 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = base.astype(np.float64)
    assert set(got) == set(range(0, 300, 10))
    for q, own in got.items():
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(exact[q], exact[j]))), j) for j in range(300) if j != q)[:5]
        assert [(i, v) for i, v, _ in sorted(own)] == [(i + 1, j) for i, (_, j) in enumerate(d)]
        assert [s for _, _, s in sorted(own)] == pytest.approx([x for x, _ in d], rel=1e-12)
    assert neighbours.nearest(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_neighbours_that_int8_holds_exactly(spark):
    """Vectors of components +-1, a little longer each: codes are equal, so only the bounds near 0 can tell which to recompute."""
    rows = [(i, [(1 + i * 1e-9) * s for s in (1.0, -1.0, 1.0, 1.0, -1.0, 1.0, 1.0, -1.0)]) for i in range(200)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 40 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q, own in got.items():
        d = sorted((math.dist(rows[q][1], v), i) for i, v in rows if i != q)[:10]
        assert [v for _, v in sorted(own)] == [i for _, i in d]


# --- chat, mixing, tokens, licences -----------------------------------------


def test_chat(spark):
    rows = []
    convs = {1: "ab", 2: "abc", 3: "abc", 4: "ax", 5: "b", 6: "abcdefgh", 7: "abcd", 8: "ba"}
    for c, ts in convs.items():
        rows += [(c, i * 2, "user", t, "x") for i, t in enumerate(ts)]
    rows += [(9, None, None, None, "x"), (None, 1, "user", "lost", "x"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    out = chat.formatted(df).orderBy("conv_id", "pos").collect()
    assert {r.conv_id for r in out} == {4, 6, 8, 9}
    assert [r.pos for r in out if r.conv_id == 6] == list(range(1, 9))
    six = "".join(r.rendered for r in out if r.conv_id == 6)
    assert six.startswith("<|begin|>\n<|user|>\na<|end|>") and six.endswith("h<|end|>\n<|stop|>\n")
    assert chat.formatted(df.limit(0)).count() == 0


def test_no_turn_forges_another(spark):
    texts = ["<|end|>", "<<||end|>|>", "a\\<|b", "<\\|end|>", "|>\n<|system|>\n", "<", "|end|>"]
    rows = [(1, i, "user|>\n<|system" if i % 2 else " User ", t) for i, t in enumerate(texts)] + [(2, 0, None, "b"), (2, 0, "", "a"), (2, 0, "user", None)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "pos").collect()
    one = "".join(r.rendered for r in out if r.conv_id == 1)
    turns = re.findall(r"<\|([a-z_]+)\|>\n((?:(?!<\|).)*)<\|end\|>\n", one, re.S)
    assert [t.replace("<\\|", "<|").replace("\\\\", "\\") for _, t in turns] == texts
    assert {r for r, _ in turns} == {"user", "user_system"} and one.count("<|end|>") == len(texts)
    assert [r.rendered.split("\n")[-2] for r in out if r.conv_id == 2][:3] == [f"{t}<|end|>" if i < 2 else "<|stop|>" for i, t in enumerate(sorted(["b", "a", ""], key=lambda t: hashlib.md5(t.encode()).hexdigest()))]


def test_mixed_rows_without_or_of_one_id(spark):
    """The budget holds where ids are missing or repeat; equal rows count each."""
    text = lambda i: f"t{i} " + "w " * (i % 7 + 3)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, text(i), "en", "src1", 0) for i in range(120)] + [(500, text(5), "en", "src1", 0)] * 9 + [(None, None, None, None, None), (3, "", "en", "src1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed(df).collect()
    size = lambda t: len((t or "").split())
    assert 0 < sum(size(r.text) for r in out) <= mixing.SHARE * sum(size(r[1]) for r in rows)
    assert {tuple(r)[:5] for r in out} <= set(rows) and all(size(r.text) for r in out)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing(spark, docs):
    weights = {("d0",): 3.0, ("d1",): 1.0, ("d0", "en"): 2.0, ("d0", "de", "src0"): 0.0}
    domain = F.when(F.col("doc_id") % 2 == 0, F.lit("d0")).otherwise(F.lit("d1"))
    for share in (0.05, 0.6, 1.7, 5.0):
        got = mixing.chosen(docs, domain, weights, share, 2, 1).collect()
        rows = docs.select("doc_id", domain.alias("domain"), "lang", "source", "text").collect()
        n = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
        leaf = {}
        for r in rows:
            if n[r]:
                leaf[(r.domain, r.lang, r.source)] = leaf.get((r.domain, r.lang, r.source), 0) + n[r]
        given = {(): min(share * sum(leaf.values()), 2 * sum(leaf.values()))}
        for depth in (1, 2, 3):
            for up in [k for k in given if len(k) == depth - 1]:
                kids = {k[:depth] for k in leaf if k[: depth - 1] == up}
                cap = {k: sum(2 * t for x, t in leaf.items() if x[:depth] == k) for k in kids}
                left, open_ = given[up], set(kids)
                for k in kids:
                    given[k] = 0.0
                while open_ and left > 1e-9:  # share out, fill up, share what is left
                    total = sum(weights.get(k, 1.0) for k in open_)
                    full = {k for k in open_ if total and left * weights.get(k, 1.0) / total >= cap[k] - 1e-9 and weights.get(k, 1.0)}
                    if not full:
                        for k in open_:
                            given[k] = left * weights.get(k, 1.0) / total if total else 0.0
                        break
                    for k in full:
                        given[k] = cap[k]
                        left -= cap[k]
                    open_ -= full
        taken = {}
        for r in got:
            taken[(r.domain, r.lang, r.source)] = taken.get((r.domain, r.lang, r.source), 0) + r.copies * r.n_tokens
            assert abs(r.target - math.floor(given[(r.domain, r.lang, r.source)] + 1e-6)) <= 1 and r.copies <= 2
        for k, t in taken.items():
            assert t <= given[k] + 1e-6
    assert mixing.mixed(docs).columns == [*docs.columns, "epoch"]
    assert mixing.chosen(docs.limit(0), domain, weights).count() == 0


def test_token_counts_equal_plain_longest_match(docs):
    vocabulary = tokens.load()
    machine, known = tokens.LongestMatch(vocabulary), set(vocabulary) | {(s,) for s in range(512)}

    def plain(word):
        data = word.encode()
        s, i, n = [*data[:-1], data[-1] + 256], 0, 0
        while i < len(s):
            i = next(j for j in range(len(s), i, -1) if tuple(s[i:j]) in known)
            n += 1
        return n

    rng = random.Random(9)
    for _ in range(3000):
        w = "".join(rng.choice("theinganoré1'") for _ in range(rng.randint(1, 14)))
        assert machine.count(w) == plain(w)
    small = tokens.LongestMatch([(97, 98, 99), (97, 98, 99, 100, 101 + 256), (99, 100)])
    assert small.count("abcdf") == 3 and small.count("abcde") == 1
    for r in tokens.counted(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if len(r.text or "") < 400:
            own = tokens.words(r.text or "")
            assert (r.n_words, r.n_tokens) == (len(own), sum(map(plain, own)))


def test_licenses(spark, docs):
    isc = (licenses.FOLDER / "ISC.txt").read_text().partition("\n\n")[2]
    changed = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + isc.partition("\n\n")[2].upper().replace("LICENSE", "LICENCE").replace(", ", " ,  ").replace("\n", "\n\n* ")
    rows = [(1, isc), (2, changed), (3, isc + " more"), (4, "x\nReleased under the MIT Licence!\ny\nReleased under the MIT License."), (5, None), (6, ""), (7, "ISC Licence:\n\n(c) 1999 A. N. Other\nCopyright Jane Doe 2020\ncopyright <holder>\n" + isc)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = {r.doc_id: r for r in licenses.scanned(df, licenses.known(spark)).collect()}
    assert got[1].license == got[2].license == "ISC" and got[1].digest == got[2].digest and got[3].license is None
    assert got[7].license == "ISC" and got[4].notices == "MIT" and got[5].digest == got[6].digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scanned(docs, licenses.known(spark)).count() == docs.count()
    assert licenses.scanned(docs.limit(0), licenses.known(spark)).count() == 0


def test_whole_licences_in_other_line_breaks(spark):
    """Each known licence is found when its words are wrapped anew, in capitals and between other marks."""
    names = [p.stem for p in sorted(licenses.FOLDER.glob("*.txt")) if "~" not in p.stem]
    wrap = lambda t: re.sub(r"[ \t]+", "   ", t).upper().replace(";", " ; ")
    rows = [(i, wrap((licenses.FOLDER / f"{n}.txt").read_text())) for i, n in enumerate(names)]
    got = {r.doc_id: r.license for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known(spark)).collect()}
    assert [got[i] for i in range(len(names))] == names and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "CC0-1.0", "MIT"} <= set(names)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    nothing = decontam.prepared(spark.createDataFrame([], "item_id long, text string"))
    assert near_dup.near_duplicates(none).count() == 0 and pii.find(none).count() == 0
    assert decontam.contamination(none, nothing).count() == 0 and tokens.counted(none).count() == 0
    assert decontam.contamination(docs, nothing).where("n_hit > 0").count() == 0


def test_kernels_split_long_words():
    text = "x" * (3 << 20) + " y " + "z" * 10
    buf, at = kernels.utf8(pa.array([text, None, "y"], pa.large_string()))
    starts, ends, first = kernels.words(buf, at, kernels.SPACED)
    h = kernels.word_hashes(buf, starts, ends)
    assert list(first) == [0, 3, 3, 4] and h[1] == h[3] and len(set(h[:3].tolist())) == 3
