"""F1-F14 scalar column helpers and the S10 regression-table builder.

All column helpers are built-in Spark expressions (codegen, no Python workers)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_n(x, digits: int) -> Column:
    """round to ``digits`` decimals (half away from zero; R rounds half to even)."""
    return F.round(_c(x), digits)


def round_to(x, step: float) -> Column:
    """Stata ``round(x, step)``: nearest multiple of step."""
    return F.round(_c(x) / F.lit(step)) * F.lit(step)


def fmt_est_se(est, se, fmt: str = "%.2f") -> Column:
    """``"est (se)"``; a missing estimate renders ``NA (NA)``."""
    e, s = _c(est), _c(se)
    return F.when(e.isNull() | s.isNull(), F.lit("NA (NA)")).otherwise(
        F.format_string(f"{fmt} ({fmt})", e, s))


def fmt_num(x, fmt: str = "%.3f") -> Column:
    """``sprintf("%.3f")`` with NA for missing."""
    return F.when(_c(x).isNull(), F.lit("NA")).otherwise(F.format_string(fmt, _c(x)))


def stars(p) -> Column:
    """F8: significance stars at .01 / .05 / .10 (``<=`` as in the Stata code)."""
    q = _c(p)
    return F.when(q <= 0.01, "***").when(q <= 0.05, "**").when(q <= 0.10, "*").otherwise("")


def stata_number(x) -> Column:
    """Stata's default display of a number already rounded to 0.01: no leading
    zero, no trailing zeros (-0.64 -> "-.64", 1.50 -> "1.5", 2.00 -> "2")."""
    s = F.format_string("%.2f", _c(x))
    s = F.regexp_replace(s, r"0+$", "")
    s = F.regexp_replace(s, r"\.$", "")
    s = F.regexp_replace(s, r"^(-?)0\.", "$1.")
    return F.when(s == "-0", F.lit("0")).otherwise(s)


def pad_coef(x) -> Column:
    """round to .01, pad a trailing "0" when shorter than 3 characters, cut to 6."""
    s = stata_number(round_to(x, 0.01))
    s = F.when(F.length(s) < 3, F.concat(s, F.lit("0"))).otherwise(s)
    return F.substring(s, 1, 6)


def tau_of(term) -> Column:
    """event time encoded at the end of a term name (``tau::-3`` -> -3)."""
    return F.regexp_extract(_c(term), r"(-?\d+)$", 1).cast("int")


def is_timing_type(typ) -> Column:
    """comparison type mentions Later or Earlier (case-insensitive)."""
    return _c(typ).rlike("(?i)later|earlier")


def is_missing(x) -> Column:
    """F12."""
    return _c(x).isNull()


def ci95(est, se, z: float = 1.96) -> tuple[Column, Column]:
    """normal 95% interval."""
    return _c(est) - z * _c(se), _c(est) + z * _c(se)


def period_range(df: DataFrame, t: str, out: str | None = None) -> DataFrame:
    """every period from min to max of ``t`` (one aggregate, then a generator)."""
    return df.agg(F.min(t).alias("_lo"), F.max(t).alias("_hi")) \
             .select(F.explode(F.sequence("_lo", "_hi")).alias(out or t))


# --- S10: regression table ---------------------------------------------------------------

def _fmt(x: float, d: int = 2) -> str:
    return "" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.{d}f}"


def _star(p: float) -> str:
    if p is None or (isinstance(p, float) and math.isnan(p)):
        return ""
    return "***" if p <= 0.01 else "**" if p <= 0.05 else "*" if p <= 0.10 else ""


def reg_table(spark: SparkSession, fits: Mapping[str, object], terms: Sequence[str],
              extra: Mapping[str, Mapping[str, dict]] | None = None, digits: int = 2) -> DataFrame:
    """Models side by side: for each selected term a coefficient row with stars
    and an ``(se)`` row; then N and R2 rows and any extra rows (e.g. a lincom).
    The cells come from coefficient-sized fit objects, so the table is assembled
    on the driver and returned as a small DataFrame."""
    models = list(fits)
    rows = []
    order = 0
    for term in terms:
        coef_row, se_row = [], []
        for m in models:
            fit = fits[m]
            if term in fit.terms:
                r = dict(zip(["term", "estimate", "se", "t", "p"], fit.rows()[fit.terms.index(term)]))
                coef_row.append(_fmt(r["estimate"], digits) + _star(r["p"]))
                se_row.append(f"({_fmt(r['se'], digits)})" if r["se"] is not None else "")
            else:
                coef_row.append("")
                se_row.append("")
        rows.append((order, term, *coef_row))
        rows.append((order + 1, "", *se_row))
        order += 2
    rows.append((order, "Observations", *[str(fits[m].n) for m in models]))
    rows.append((order + 1, "R-squared", *[_fmt(fits[m].r2, 3) for m in models]))
    order += 2
    for label, cells in (extra or {}).items():
        row = []
        for m in models:
            c = cells.get(m)
            row.append(_fmt(c["estimate"], digits) + _star(c["p"]) if c else "")
        rows.append((order, label, *row))
        prow = [f"[{_fmt(cells[m]['p'], 2)}]" if cells.get(m) else "" for m in models]
        rows.append((order + 1, "p-value", *prow))
        order += 2
    schema = "row_order int, label string, " + ", ".join(f"`{m}` string" for m in models)
    return spark.createDataFrame(rows, schema)
