"""Golden: the stage-2 regressions of the published mortality two-stage table
(16 printed event-time coefficients and standard errors)."""

import pytest

from panelkit.operators.regression import stage2

# Printed stage-1 series (tau, coefficient, standard error).
SIGMA16 = [
    (-10, 28.40485, 6.781441), (-9, 29.88231, 6.774871), (-8, 29.96994, 6.683447), (-7, 27.81668, 6.66934),
    (-6, 29.35389, 6.661593), (-5, 29.28037, 6.665542), (-4, 27.65671, 6.644357), (-3, 28.00693, 6.600787),
    (-2, 26.37069, 6.644877), (-1, 27.47369, 6.598355), (0, 28.74357, 6.555928), (1, 29.89251, 6.555829),
    (2, 25.48456, 6.486092), (3, 28.88633, 6.425878), (4, 25.91804, 6.379772), (5, 22.73977, 6.333642),
]

# Expected (model, term) -> (estimate, se).
EXPECTED = {
    ("2a", "post"): (-1.49755, 0.96913), ("2a", "const"): (28.41669, 0.59959),
    ("2b", "post"): (1.82179, 1.51105), ("2b", "tau"): (-0.41495, 0.15908), ("2b", "const"): (26.14386, 1.00666),
    ("2c", "post"): (3.57238, 1.49474), ("2c", "tau"): (-0.26327, 0.15101),
    ("2c", "post_trend"): (-0.84156, 0.35571), ("2c", "const"): (26.97469, 0.93377),
    ("2c", "post + 5*post_trend"): (-0.63545, 1.66296),
}


def test_stage2_golden(spark):
    sig = spark.createDataFrame(SIGMA16, "tau int, taub double, tause double")
    out = {(r["model"], r["term"]): r for r in stage2(sig).collect()}
    for key, (est, se) in EXPECTED.items():
        assert out[key]["estimate"] == pytest.approx(est, abs=6e-5), key
        assert out[key]["se"] == pytest.approx(se, abs=6e-5), key
    assert out[("2a", "post")]["n"] == 16
    assert out[("2a", "post")]["r2"] == pytest.approx(0.1457, abs=5e-4)
