from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipquarry.functions import kernels as K


def slow_dtw(a, b, window):
    a, b = K.unit_rows(a), K.unit_rows(b)
    n, m = len(a), len(b)
    w = max(n, m) if window is None else max(window, abs(n - m))
    d = {(0, 0): 0.0}
    for i in range(1, n + 1):
        for j in range(max(1, i - w), min(m, i + w) + 1):
            d[i, j] = 1 - a[i - 1] @ b[j - 1] + min(d.get((i - 1, j), np.inf), d.get((i, j - 1), np.inf), d.get((i - 1, j - 1), np.inf))
    return d[n, m]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 5), st.integers(0, 10**6))
def test_dtw_equals_cell_by_cell(n, m, w, seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(n, 3)), r.normal(size=(m, 3))
    assert K.dtw_distance(a, b, w) == pytest.approx(slow_dtw(a, b, w))
    assert K.dtw_distance(a, b) == pytest.approx(slow_dtw(a, b, None))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 5), st.integers(0, 10**6))
def test_bound_is_admissible(n, m, w, seed):
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(n, 3)), r.normal(size=(m, 3))
    assert K.envelope_bound(a, b, w) <= K.dtw_distance(a, b, w) + 1e-9


def test_bound_where_evenly_spread_centres_fail():
    a, b = np.array([[1.0, 0]] * 6 + [[0, 1.0]] * 4), np.array([[1.0, 0]] * 3 + [[0, 1.0]] * 9)
    assert K.dtw_distance(a, b, 3) == pytest.approx(0)
    assert K.envelope_bound(a, b, 3) == pytest.approx(0)
    assert K.envelope_bound(a, b, 3, aligned=True) > 0.5


def test_warped_copy_is_near_and_opposite_is_far():
    a = np.eye(3)[[0, 1, 2, 2]]
    warped = np.eye(3)[[0, 0, 1, 2, 2]]
    assert K.dtw_distance(a, warped, 2) < 1e-4 < K.dtw_distance(a, -a, 2)


def test_path_prefers_a_step_in_the_first_series():
    same = np.tile([1.0, 0.0], (3, 1))
    path = K.dtw_path(same, same)
    assert path[0] == (0, 0) and path[-1] == (2, 2)
    assert path == [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2)]
    assert K.dtw_path(same[:1], same) == [(0, 0), (0, 1), (0, 2)]


def test_windows_and_their_limits():
    assert K.window_for(10, 8) == 2 and K.window_for(3, 9) == 6 and K.window_for(10, 10, 0.25) == 3
    with pytest.raises(ValueError):
        K.window_for(3, 3, 1.5)
    with pytest.raises(ValueError):
        K.dtw_distance(np.ones((2, 2)), np.ones((2, 2)), -1)
    with pytest.raises(ValueError):
        K.unit_rows(np.empty((0, 2)))


def test_zero_rows_stay():
    assert K.unit_rows([[0, 0], [3, 4]]).tolist() == [[0, 0], [0.6, 0.8]]


@given(st.integers(1, 5), st.integers(1, 4), st.integers(0, 10**6))
def test_packing_round_trip(rows, bytes_, seed):
    x = np.random.default_rng(seed).integers(0, 4, (rows, bytes_ * 4))
    packed = K.pack2(x)
    assert packed.shape == (rows, bytes_)
    assert (K.unpack2(packed, x.shape[1]) == x).all()
    assert packed[0, 0] == x[0, 0] + 4 * x[0, 1] + 16 * x[0, 2] + 64 * x[0, 3]


def test_packing_rejects_other_widths():
    with pytest.raises(ValueError):
        K.pack2(np.zeros((1, 6)))


def test_nearest_takes_the_first_of_equals():
    assert K.nearest(np.array([[0.0], [1.0], [3.0]]), np.array([[-1.0], [1.0], [1.0]])).tolist() == [0, 1, 1]


def test_maxsim():
    assert K.maxsim(np.eye(2), np.eye(2)) == pytest.approx(2)
    assert K.maxsim(np.eye(2), [[1.0, 0]]) == pytest.approx(1)
