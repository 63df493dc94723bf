"""What the findings of round 3 were about: partners that a cut dropped."""

import numpy as np

from busframe.llm import jaccard, quality


def test_all_rows_of_a_large_prefix_meet(spark, monkeypatch):
    """Rows that share a prefix with more rows than a part holds are linked, whichever part a hash deals them to."""
    monkeypatch.setattr(jaccard, "BUCKET_ROWS", 8)
    rng = np.random.default_rng(3)
    rows = []
    for pair in range(30):
        sign = rng.integers(0, 1 << 16, 12, dtype=np.uint16)
        sign[0] = 7  # shared by all
        rows += [(2 * pair + i, bytearray(sign.astype(">u2").tobytes())) for i in (0, 1)]
    sets = spark.createDataFrame(rows, "sid long, labels binary")
    links = jaccard.candidate_links(sets, similarity=0.8, trees=1, labels=12, recall=0.999)
    assert {tuple(sorted(r)) for r in links.collect()} == {(2 * i, 2 * i + 1) for i in range(30)}


def test_scorer_of_sorted_features():
    """Weights stand at the features that documents have."""
    made = quality.fit_scorer(np.array([3, 9, 9, 3, 5], np.int32), np.array([2, 1, 2], np.int32), np.array([1.0, 0.0, 1.0]), 4)
    assert set(np.flatnonzero(made.weights)) == {3, 5, 9} and made.weights[3] > 0 > made.weights[9]
