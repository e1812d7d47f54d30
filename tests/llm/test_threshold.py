"""The language threshold is by all texts to learn from."""

import numpy as np
import pyarrow as pa

from plumbline.llm import langid


def test_threshold_counts_every_text(spark):
    net = langid.train([("en", b"the of and to a one two three " * 9), ("de", "der die das und für über ".encode() * 9)], steps=40)
    texts = ["the of and to a one two three " * (1 + i % 7) + "und der " * (i % 5) for i in range(1200)] + ["für über das one " * 3, "kurz", None, "", "12 34"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    judged = [t for t in texts if t and langid._letters(pa.array([t], pa.large_string()))[0] >= langid.JUDGED]
    score = np.sort(langid.decide(net, pa.array(judged, pa.large_string()))[1])
    want = langid.MARGIN * score[int(langid.BELOW * (len(score) - 1))]
    assert abs(langid.threshold(net, docs) - want) <= 2 / langid.BINS
    assert langid.threshold(net, docs.limit(0)) == langid.threshold(None, docs) == 0.0
