import numpy as np
import pyarrow as pa
from tesserine.operators.vectors import _Best, _units


def test_a_task_holds_few_more_than_the_best():
    rng, best = np.random.default_rng(1), _Best(300, 3, -np.inf)
    scores = np.round(rng.normal(size=(300, 5000)), 2)  # with ties
    scores[:, 7] = -np.inf
    for at in range(0, 5000, 1000):
        for first in (0, 150):
            best.offer(first, scores[first : first + 150, at : at + 1000], np.arange(at, at + 1000))
    assert best.size < 20_000  # all 1,500,000 were held
    q, t, s = best.settle()
    want = [(i, int(j), scores[i, j]) for i in range(300) for j in np.lexsort((np.arange(5000), -scores[i]))[:3]]
    assert list(zip(q.tolist(), t.tolist(), s.tolist())) == want


def test_few_terms_and_no_scores():
    best = _Best(2, 5, -np.inf)
    best.offer(0, np.array([[0.5, -np.inf], [-np.inf, -np.inf]]), np.array([8, 9]))
    assert [x.tolist() for x in best.settle()] == [[0], [8], [0.5]]


def test_units():
    rows = [None, [3.0, 4.0], [1.0], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e200, 1e200], []]
    x, good = _units(pa.array(rows, pa.list_(pa.float64())).slice(1))
    assert good.tolist() == [True] + [False] * 7
    assert x.tolist() == [[0.6, 0.8]] + [[0.0, 0.0]] * 7
    assert _units(pa.array([], pa.list_(pa.float64())))[0].shape == (0, 0)
