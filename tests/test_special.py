import math

import numpy as np

from zonata.functions import special as S


def test_chi2_closed_form():
    for x in (0.1, 1.0, 3.925016589826722, 20.0, 90.0):
        assert math.isclose(S.chi2_sf(x, 4), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-10)
    assert math.isclose(S.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)


def test_f_and_normal():
    assert math.isclose(S.f_sf(4.0, 2, 10), (1 + 2 * 4.0 / 10) ** -5, rel_tol=1e-10)  # closed form for df1 = 2
    assert math.isclose(S.normal_sf(1.959963984540054), 0.025, rel_tol=1e-9)
    assert math.isclose(S.normal_quantile(0.975), 1.959963984540054, rel_tol=1e-9)


def test_studentized_range():
    # tabulated upper 5 % points
    for q, k, df in ((3.877, 3, 10), (4.232, 5, 20), (3.151, 2, 10)):
        assert abs(S.studentized_range_sf(q, k, df) - 0.05) < 5e-4


def test_range_of_two_is_a_normal():
    w = np.array([0.5, 2.0, 3.0])
    assert np.allclose(1 - S._range_cdf(w, 2), [2 * S.normal_sf(x / math.sqrt(2)) for x in w], atol=1e-6)
