import math

from panelkit.functions.dist import p_chi2, p_normal, p_t


def test_normal():
    assert abs(p_normal(1.959963984540054) - 0.05) < 1e-12
    assert p_normal(0.0) == 1.0


def test_student_t():
    assert abs(p_t(2.0, 10) - 0.07338803477074) < 1e-10
    assert abs(p_t(-2.228138851986274, 10) - 0.05) < 1e-10
    assert abs(p_t(1.0, 1) - 0.5) < 1e-12            # Cauchy
    assert math.isnan(p_t(float("nan"), 5))


def test_chi2():
    assert abs(p_chi2(3.841458820694124, 1) - 0.05) < 1e-10
    assert abs(p_chi2(10.0, 5) - 0.07523524614651217) < 1e-10
    assert abs(p_chi2(2.0, 2) - math.exp(-1.0)) < 1e-12
