"""Sums over windows of cells: copies stay in their task."""

import numpy as np
import pytest

from tailfield.operators import windows as wi

RNG = np.random.default_rng(3)


def test_box_sums_move_cells_not_copies(spark):
    cells = [(int(r), int(c), int(h), None if h and s < 0.1 else float(s)) for r, c, h, s in zip(
        RNG.integers(-20, 60, 300), RNG.integers(-5, 40, 300), RNG.integers(0, 2, 300), RNG.uniform(size=300), strict=True)]
    out = wi.box_statistics(spark.createDataFrame(cells, "row long, col long, hot int, score double"), 3, "score", "hot")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 2 and "Join" not in text
    got = {(r["row"], r["col"]): (r["n_points"], r["n_hotspots"], r["mean_score"], r["max_score"]) for r in out.collect()}
    assert set(got) == {c[:2] for c in cells} and out.count() == len(got)
    for (row, col), found in got.items():
        near = [c for c in cells if abs(c[0] - row) <= 3 and abs(c[1] - col) <= 3]
        scores = [c[3] for c in near if c[3] is not None]
        assert found == (len(near), sum(c[2] for c in near), pytest.approx(np.mean(scores)) if scores else None, max(scores, default=None))
