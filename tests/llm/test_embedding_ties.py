"""Links at exactly the threshold, in several dimensions, at several scales."""

import numpy as np
import pytest

from topicspark.llm import embeddings


@pytest.mark.parametrize("dims", [4, 16, 64])
def test_ties(spark, dims):
    rng = np.random.default_rng(dims)
    rows = []
    for k in range(24):
        # e and f with e.f = 9, |e| = 1, |f| = 10: a cosine of exactly 0.9
        at = rng.permutation(dims)[:4]
        e, f = np.zeros(dims), np.zeros(dims)
        e[at[0]] = 1
        f[at] = [9, 3, 3, 1]
        below = f.copy()
        below[at[3]] = 1.0001
        rows += [(4 * k, (e * 2.0 ** rng.integers(-300, 300)).tolist()), (4 * k + 1, (f * 2.0 ** rng.integers(-300, 300)).tolist()), (4 * k + 2, below.tolist()), (4 * k + 3, (f * 3).tolist())]
    x = np.array([np.array(r[1]) / 2.0 ** np.frexp(np.abs(r[1]).max())[1] for r in rows])
    norm = np.sqrt(np.outer((x * x).sum(axis=1), (x * x).sum(axis=1)))
    want = (x @ x.T) / norm >= 0.9
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: int(want[k].sum()) - 1 for k in range(len(rows))}
    assert all(want[4 * k, 4 * k + 1] and not want[4 * k, 4 * k + 2] for k in range(24))
