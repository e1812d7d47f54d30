"""What near duplicates leave on disk, and that few and many links give the same."""

import random
from pathlib import Path

import numpy as np
import pytest

from plumbline import session
from plumbline.llm import near_dup
from plumbline.operators import graph


def drifted(spark):
    """Chains of copies of copies, in one bucket and others, so that several rounds follow."""
    rng, rows = random.Random(5), []
    for g in range(3):
        ws = [f"w{g}{i}" for i in range(40)]
        for _ in range(25):
            rows.append((len(rows), " ".join(ws)))
            ws[rng.randrange(40)] = f"x{rng.random()}"
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_rounds_leave_few_files(spark, monkeypatch):
    """Each shuffle partition more adds a file for each of a fixed few interim results, not for each of every round."""
    monkeypatch.setattr(near_dup, "PAIRS_AN_ENTRY", 0)  # rounds as long as they link any
    folder, left = Path(session.shared_dir(spark).removeprefix("file:")), []
    files = lambda: sum(1 for _ in folder.rglob("part-*"))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (8, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            there = files()
            assert near_dup.near_duplicates(drifted(spark)).count() == 75
            left.append(files() - there)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert left[1] - left[0] <= 8 * 8


def test_few_and_many_links_give_the_same(spark, monkeypatch):
    """Interim results in one partition or several, pairs sent or shuffled."""
    of = lambda: sorted(map(tuple, near_dup.near_duplicates(drifted(spark)).collect()))
    few = of()
    monkeypatch.setattr(session, "ROWS", 20)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 10)
    assert of() == few and len(few) == 75


@pytest.mark.parametrize("seed", range(3))
def test_components_of_few_links(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(int(a) - 50, int(b) - 50) for a, b in rng.integers(0, 400, (150, 2))] + [(7, 7), (None, 9), (1000, None), (None, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    of = lambda labels: sorted(map(tuple, labels.collect()))
    assert of(graph.components(edges, "a", "b", len(pairs))) == of(graph.components(edges, "a", "b"))
    start, more = edges.limit(100), spark.createDataFrame([(3, 2000), (5, 350), (2001, 2002)], "a long, b long")
    labels = graph.components(start, "a", "b")
    assert of(graph.merged(labels, more, "a", "b", 1000)) == of(graph.merged(labels, more, "a", "b"))
    assert graph.components(edges.where("a > 5000"), "a", "b", 0).count() == 0


def test_roots_of_long_paths_and_stars():
    order = np.random.default_rng(1).permutation(5000)
    assert (graph.least_roots(5000, order[:-1], order[1:]) == 0).all()
    assert (graph.least_roots(5000, np.full(4999, 4999), np.arange(4999)) == 0).all()
