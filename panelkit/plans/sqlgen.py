"""SQL text for the DuckDB oracle of small least-squares problems.

The oracle side has no matrix algebra, so for k <= 3 regressors the inverse
of the Gram matrix is written out by cofactors.  Used only to build oracle
strings; the Spark side never runs this."""

from __future__ import annotations

from itertools import product


def _g(a: int, b: int) -> str:
    a, b = min(a, b), max(a, b)
    return f"g{a}{b}"


def inverse_exprs(k: int) -> dict[tuple[int, int], str]:
    """Entries of the inverse of the symmetric matrix [g_ab] (1-based), as SQL over gm columns."""
    if k == 1:
        return {(1, 1): "1.0 / g11"}
    if k == 2:
        det = "(g11 * g22 - g12 * g12)"
        return {(1, 1): f"g22 / {det}", (2, 2): f"g11 / {det}", (1, 2): f"-g12 / {det}", (2, 1): f"-g12 / {det}"}
    if k == 3:
        def m(i, j):
            return _g(i, j)
        c = {}
        for i, j in product(range(1, 4), range(1, 4)):
            r = [x for x in range(1, 4) if x != i]
            s = [x for x in range(1, 4) if x != j]
            minor = f"({m(r[0], s[0])} * {m(r[1], s[1])} - {m(r[0], s[1])} * {m(r[1], s[0])})"
            sign = "" if (i + j) % 2 == 0 else "-"
            c[(i, j)] = f"{sign}{minor}"
        det = f"(g11 * {c[(1, 1)]} + g12 * {c[(1, 2)]} + g13 * {c[(1, 3)]})"
        # inverse = adjugate / det, adjugate = cofactor transposed (symmetric here)
        return {(i, j): f"({c[(j, i)]}) / {det}" for i, j in product(range(1, 4), range(1, 4))}
    raise ValueError("k <= 3 only")


def fe_ols_sql(dm_cte: str, terms: list[str], t_count: str, lincom: dict[str, float] | None = None,
               stats: bool = False) -> str:
    """Given a CTE ``dm`` (columns unit, w, yy, x1..xk: two-way demeaned), SQL returning
    (term, estimate, se, t_stat) with cluster-by-unit se, K = k + T - 1
    (or one lincom row, or fit statistics)."""
    k = len(terms)
    inv = inverse_exprs(k)
    g_cols = [f"sum(w * x{a} * x{b}) AS g{a}{b}" for a in range(1, k + 1) for b in range(a, k + 1)]
    g_cols += [f"sum(w * x{a} * yy) AS gy{a}" for a in range(1, k + 1)]
    g_cols += ["sum(w * yy * yy) AS gyy", "count(*) AS n", f"({t_count}) AS tt"]
    inv_cols = [f"{inv[(a, b)]} AS i{a}{b}" for a in range(1, k + 1) for b in range(1, k + 1)]
    beta_cols = [" + ".join(f"i{a}{b} * gy{b}" for b in range(1, k + 1)) + f" AS b{a}" for a in range(1, k + 1)]
    e_expr = "yy - " + " - ".join(f"(SELECT b{a} FROM bt) * x{a}" for a in range(1, k + 1))
    score_cols = [f"sum(w * x{a} * e) AS s{a}" for a in range(1, k + 1)]
    meat_cols = [f"sum(s{a} * s{b}) AS m{a}{b}" for a in range(1, k + 1) for b in range(1, k + 1)]
    meat_cols += ["count(*) AS ng", "sum(ssr_u) AS ssr"]

    def v(a: int, b: int) -> str:
        return " + ".join(f"i{a}{c} * m{c}{d} * i{d}{b}" for c in range(1, k + 1) for d in range(1, k + 1))

    corr = "(ng * 1.0 / (ng - 1)) * ((n - 1) * 1.0 / (n - (" + str(k) + " + tt - 1)))"
    sql = f"""{dm_cte},
gm AS (SELECT {', '.join(g_cols)} FROM dm),
iv AS (SELECT *, {', '.join(inv_cols)} FROM gm),
bt AS (SELECT *, {', '.join(beta_cols)} FROM iv),
re AS (SELECT unit, w, {', '.join(f'x{a}' for a in range(1, k + 1))}, {e_expr} AS e FROM dm),
su AS (SELECT unit, {', '.join(score_cols)}, sum(w * e * e) AS ssr_u FROM re GROUP BY unit),
mt AS (SELECT {', '.join(meat_cols)} FROM su),
vv AS (SELECT bt.*, mt.*, {corr} AS c FROM bt, mt)
"""
    if lincom:
        cvec = {terms.index(t) + 1: wgt for t, wgt in lincom.items()}
        est = " + ".join(f"{wgt} * b{a}" for a, wgt in cvec.items())
        var = " + ".join(f"{wa} * {wb} * c * ({v(a, b)})" for a, wa in cvec.items() for b, wb in cvec.items())
        return sql + f"""SELECT round({est}, 6) + 0.0 AS estimate, round(sqrt({var}), 6) + 0.0 AS se,
       round(({est}) / sqrt({var}), 6) + 0.0 AS t_stat FROM vv"""
    if stats:
        return sql + """SELECT n, ng AS n_units, CAST(""" + str(k) + """ + tt - 1 AS BIGINT) AS K,
       round(ssr, 4) + 0.0 AS ssr_w, round(1 - ssr / gyy, 6) + 0.0 AS r2_within FROM vv"""
    rows = [f"SELECT '{t}' AS term, round(b{a}, 6) + 0.0 AS estimate, round(sqrt(c * ({v(a, a)})), 6) + 0.0 AS se, "
            f"round(b{a} / sqrt(c * ({v(a, a)})), 6) + 0.0 AS t_stat FROM vv" for a, t in enumerate(terms, 1)]
    return sql + "\nUNION ALL\n".join(rows)


def sweep_ctes(m: str, source: str, y: str, terms: dict[str, str], w: str, fe: bool = True, iid: bool = False,
               lincoms: dict[str, dict[str, str]] | None = None, partial: bool = False) -> str:
    """CTEs named ``{m}_..`` that fit ``y`` on ``terms`` (name -> SQL expression) over table ``source`` by the sweep operator.

    With ``fe``, columns are weighted-demeaned by ``unit`` and period dummies of
    ``t`` go in first; else the caller adds a constant among the terms.  The Gram
    matrix is a list of lists and a recursive CTE sweeps one column a level,
    leaving out those whose pivot is below 1e-9 of their variance before
    demeaning.  ``{m}_out`` has pos, term, estimate, se, t_stat, df, n, r2 of the
    terms and of ``lincoms`` (name -> {term: weight expression}); left-out terms
    are null, and so are combinations with one unless ``partial``.  Errors are clustered by unit (K counts kept columns) or classical."""
    k = len(terms)
    dummies = f"list_transform(range(1, {m}_nt.nt), lambda q: CASE WHEN q = p.p THEN 1.0 ELSE 0.0 END)" if fe else "CAST([] AS DOUBLE[])"
    mean = f"- sum(w * v) OVER (PARTITION BY unit, j) / sum(w) OVER (PARTITION BY unit, j)" if fe else ""
    names = list(terms)
    combos = [(pos, name, {name: "1.0"}) for pos, name in enumerate(names)]
    combos += [(k + i, name, ws) for i, (name, ws) in enumerate((lincoms or {}).items())]
    index = {name: i for i, name in enumerate(names)}
    weights = ",\n  ".join(f"({pos}, '{name}', {index[t]}, {wt})" for pos, name, ws in combos for t, wt in ws.items())
    var = (f"ssr / (n - kk) * (SELECT sum(a.wt * b.wt * mat[nt - 1 + a.j][nt - 1 + b.j]) FROM {m}_wt a JOIN {m}_wt b ON a.pos = b.pos WHERE a.pos = c.pos)" if iid else
           f"(ng / (ng - 1.0)) * ((n - 1.0) / (n - kk)) * (SELECT sum(s * s) FROM (SELECT sum(f.wt * f.psi) AS s FROM {m}_psi f WHERE f.pos = c.pos GROUP BY f.unit))")
    return f"""
{m}_src AS (SELECT row_number() OVER () AS r, unit, t, CAST({w} AS DOUBLE) AS w, CAST([{', '.join(f'CAST({e} AS DOUBLE)' for e in terms.values())}] AS DOUBLE[]) AS x,
  CAST({y} AS DOUBLE) AS y FROM {source}),
{m}_p AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS INTEGER) AS p FROM (SELECT DISTINCT t FROM {m}_src)),
{m}_nt AS (SELECT {'CAST(count(*) AS INTEGER)' if fe else '1'} AS nt FROM {m}_p),
{m}_vec AS (SELECT r, unit, w, list_append(list_concat({dummies}, x), y) AS vec FROM {m}_src s JOIN {m}_p p ON p.t = s.t, {m}_nt),
{m}_long0 AS (SELECT r, unit, w, unnest(vec) AS v, unnest(range(1, len(vec) + 1)) AS j FROM {m}_vec),
{m}_long AS (SELECT r, unit, w, j, v, v {mean} AS d FROM {m}_long0),
{m}_raw AS (SELECT list(s ORDER BY j) AS raw FROM (
  SELECT j, {'sum(w * v * v) - sum(w * v) * sum(w * v) / sum(w)' if fe else 'sum(w * v * v)'} AS s FROM {m}_long GROUP BY j)),
{m}_gram AS (SELECT a.j AS i, b.j AS j, sum(a.w * a.d * b.d) AS s FROM {m}_long a JOIN {m}_long b ON a.r = b.r GROUP BY a.j, b.j),
{m}_mat AS (SELECT list(line ORDER BY i) AS mat FROM (SELECT i, list(s ORDER BY j) AS line FROM {m}_gram GROUP BY i)),
{m}_sw(step, mat, kept) AS (
  SELECT 1, mat, CAST([] AS BOOLEAN[]) FROM {m}_mat
  UNION ALL
  SELECT step + 1,
    CASE WHEN mat[step][step] > 1e-9 * raw[step] AND mat[step][step] > 0 THEN list_transform(mat, lambda line, i:
      list_transform(line, lambda z, j: CASE WHEN i = step AND j = step THEN 1.0 / z WHEN i = step THEN z / mat[step][step]
        WHEN j = step THEN -z / mat[step][step] ELSE z - line[step] * mat[step][j] / mat[step][step] END)) ELSE mat END,
    list_append(kept, mat[step][step] > 1e-9 * raw[step] AND mat[step][step] > 0)
  FROM {m}_sw, {m}_raw WHERE step < len(mat)),
{m}_fit AS (SELECT s.mat, s.kept, len(s.mat) AS m, nt, s.mat[len(s.mat)][len(s.mat)] AS ssr, raw[len(s.mat)] AS tss
  FROM {m}_sw s, {m}_raw, {m}_nt WHERE s.step = len(s.mat)),
{m}_e AS (SELECT r, unit, w, sum(CASE WHEN j = m THEN d WHEN kept[j] THEN -mat[j][m] * d ELSE 0.0 END) AS e FROM {m}_long, {m}_fit GROUP BY r, unit, w),
{m}_sc AS (SELECT l.unit, j, sum(l.w * l.d * e.e) AS s FROM {m}_long l JOIN {m}_e e ON e.r = l.r, {m}_fit WHERE kept[j] GROUP BY l.unit, j),
{m}_wt0(pos, term, j, wt) AS (VALUES
  {weights}),
{m}_wt AS (SELECT pos, term, j + 1 AS j, wt FROM {m}_wt0{f", {m}_fit WHERE kept[nt + j]" if partial else ""}),
{m}_psi AS (SELECT c.pos, c.wt, s.unit, sum(mat[nt - 1 + c.j][s.j] * s.s) AS psi FROM {m}_wt c, {m}_sc s, {m}_fit GROUP BY c.pos, c.wt, c.j, s.unit),
{m}_n AS (SELECT count(*) AS n, count(DISTINCT unit) AS ng, sum(w) AS sw, sum(w * y) AS swy, sum(w * y * y) AS swyy FROM {m}_src),
{m}_k AS (SELECT len(list_filter(kept, lambda b: b)){f' + ng' if iid and fe else ''} AS kk FROM {m}_fit, {m}_n),
{m}_c AS (SELECT pos, term, CASE WHEN bool_and(kept[nt - 1 + j]) THEN sum(wt * mat[nt - 1 + j][m]) END AS estimate FROM {m}_wt, {m}_fit GROUP BY pos, term),
{m}_se AS (SELECT pos, term, estimate, CASE WHEN estimate IS NOT NULL THEN sqrt({var}) END AS se,
  {'n - kk' if iid else 'ng - 1'} AS df, n, 1 - ssr / (swyy - swy * swy / sw) AS r2 FROM {m}_c c, {m}_fit, {m}_n, {m}_k),
{m}_out AS (SELECT *, estimate / se AS t_stat FROM {m}_se)"""


def t_pvalues(source: str) -> str:
    """``source`` (with t_stat, df) and p_value: both tails of Student's t, by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    tail = "(pi() / 2 - atan(abs(t_stat) / sqrt(df)))"
    return f"""(SELECT s.*, (SELECT CASE WHEN s.t_stat IS NOT NULL THEN 2 * exp(lgamma((s.df + 1) / 2.0) - lgamma(s.df / 2.0)) / sqrt(pi())
    * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(sin(s.tail * (4000 - i) / 4000.0), s.df - 1)) * s.tail / 12000 END
    FROM range(4001) q(i)) AS p_value FROM (SELECT *, {tail} AS tail FROM {source}) s)"""


def normal_p_sql(z: str) -> str:
    """Both tails of the normal distribution, by Simpson's rule over 14 standard deviations."""
    return (f"(SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(abs({z}) + i * 0.0035, 2) / 2)) * 0.0035 / 3 "
            f"* 2 / sqrt(2 * pi()) FROM range(4001) q(i))")


def chi2_p_sql(x: str, df: str) -> str:
    """Upper tail of the chi-square distribution (df >= 2), by Simpson's rule over [0, x]."""
    return (f"(SELECT 1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow({x} * i / 4000.0, {df} / 2.0 - 1) * exp(-{x} * i / 8000.0)) "
            f"* {x} / 12000 / (pow(2, {df} / 2.0) * exp(lgamma({df} / 2.0))) FROM range(4001) q(i))")


def wald_ctes(m: str, psi: str, b: str) -> str:
    """CTE ``{m}_out`` (chi2, df, n_omitted): b' V^-1 b of the estimates ``b`` (j, b), V the sum over units of products of ``psi`` (unit, j, x).

    The bordered matrix [V b; b' 0] is eliminated column by column, leaving out those with less than 1e-9 of their variance left."""
    return f"""
{m}_v AS (SELECT a.j AS i, c.j AS j, sum(a.x * c.x) AS s FROM {psi} a JOIN {psi} c ON a.unit = c.unit GROUP BY a.j, c.j),
{m}_mat AS (SELECT list_append(list(list_append(line, b) ORDER BY i), list_append(list(b ORDER BY i), 0.0)) AS mat, list(line[r] ORDER BY i) AS raw
  FROM (SELECT i, list(s ORDER BY j) AS line, row_number() OVER (ORDER BY i) AS r FROM {m}_v GROUP BY i) l JOIN {b} e ON e.j = l.i),
{m}_sw(step, mat, raw, df) AS (
  SELECT 1, mat, raw, CAST(0 AS BIGINT) FROM {m}_mat
  UNION ALL
  SELECT step + 1, CASE WHEN mat[step][step] > 1e-9 * raw[step] AND mat[step][step] > 0
      THEN list_transform(mat, lambda line: list_transform(line, lambda z, j: z - line[step] * mat[step][j] / mat[step][step])) ELSE mat END,
    raw, df + CASE WHEN mat[step][step] > 1e-9 * raw[step] AND mat[step][step] > 0 THEN 1 ELSE 0 END
  FROM {m}_sw WHERE step < len(mat)),
{m}_out AS (SELECT -mat[len(mat)][len(mat)] AS chi2, df, CAST(len(raw) AS BIGINT) - df AS n_omitted FROM {m}_sw WHERE step = len(mat))"""
