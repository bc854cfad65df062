"""The forest of operator 6 is drawn from all labelled rows, and its threshold counts all of them."""

import numpy as np
import pandas as pd

from sessiontide.llm import quality


def test_threshold_of_a_table(spark):
    rng = np.random.default_rng(3)
    scores = np.round(rng.random(9000), 3)  # many equal ones, and more rows than the sample once had
    labels = (rng.random(9000) > scores**2).astype(int)
    frame = spark.createDataFrame(pd.DataFrame({"score": scores, "label": labels})).repartition(5)
    assert quality.threshold(frame, 1.0) == quality.calibrate(scores, labels == 1, 1.0) < 1
    assert quality.threshold(frame.filter("label = 1")) == float("inf")


def test_trees_draw_from_all_rows(spark):
    rows = pd.DataFrame({"doc_id": np.arange(9000), **{f: np.arange(9000) + k / 10 for k, f in enumerate(quality.FEATURES)}})
    frame = spark.createDataFrame(rows)
    one, other = (quality.tree_draws(frame.repartition(n)) for n in (2, 7))
    assert len(one) == quality.TREES and all(len(d) == quality.DRAW for d in one)
    assert all((a == b).all() for a, b in zip(one, other, strict=True))  # however rows are dealt
    drawn = np.unique(np.concatenate([d[:, 0] for d in one]))
    assert len(drawn) > 8000  # the sample of 6,000 rows held no more than that; 94 % of rows are expected
    assert np.abs([d[:, 0].mean() - 4500 for d in one]).max() < 5 * 2600 / 16
