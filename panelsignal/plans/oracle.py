"""Independent DuckDB SQL for every registered query.

Written directly with sliding window frames, ``regr_*`` / ``covar_pop``
aggregates and Cramer's rule - not with the prefix sums, numpy solves or
broadcast joins of the Spark side - so that agreement is a real check.
Null policy as in the engine: ``ln(1+x)`` only for x > -1, every ratio
through ``NULLIF``.  Results are rounded to 6 decimals; ``+ 0.0`` turns
DuckDB's ``-0.0`` into ``0.0``.
"""

from __future__ import annotations

import itertools

DIGITS = 6
START, END = "1995-01-01", "2001-12-31"


def rnd(expr: str, digits: int = DIGITS) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


PANEL = f"""
panel_raw AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(l_suppkey AS BIGINT) AS asset_id,
         round(sum(l_extendedprice) / sum(l_quantity), 10) AS price,
         round(100.0::DOUBLE * (avg(l_discount) - 0.05::DOUBLE), 10) AS "return",
         round(100.0::DOUBLE * (avg(l_tax) - 0.04::DOUBLE), 10) AS specific_return,
         round(avg(l_quantity), 10) AS specific_risk,
         round(0.5::DOUBLE + avg(l_linenumber) / 4.0::DOUBLE, 10) AS predicted_beta
  FROM lineitem GROUP BY 1, 2
),
panel AS (
  SELECT date, asset_id, price,
         "return" / 100.0::DOUBLE AS "return",
         specific_return / 100.0::DOUBLE AS specific_return,
         specific_risk / 100.0::DOUBLE AS specific_risk,
         predicted_beta
  FROM panel_raw
  WHERE date BETWEEN DATE '{START}' AND DATE '{END}'
)"""

FACTORS = f"""
factors AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
    round(avg(l_discount) - 0.05::DOUBLE, 10) AS mkt_rf,
    round(coalesce(avg(CASE WHEN l_quantity <= 25 THEN l_discount END)
                 - avg(CASE WHEN l_quantity > 25 THEN l_discount END), 0.0::DOUBLE), 10) AS smb,
    round(coalesce(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END)
                 - avg(CASE WHEN l_returnflag = 'N' THEN l_discount END), 0.0::DOUBLE), 10) AS hml,
    round(coalesce(avg(CASE WHEN l_linestatus = 'O' THEN l_tax END)
                 - avg(CASE WHEN l_linestatus = 'F' THEN l_tax END), 0.0::DOUBLE), 10) AS rmw,
    round(coalesce(avg(CASE WHEN l_linenumber <= 3 THEN l_tax END)
                 - avg(CASE WHEN l_linenumber > 3 THEN l_tax END), 0.0::DOUBLE), 10) AS cma,
    0.0001::DOUBLE AS rf
  FROM lineitem
  WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
  GROUP BY 1
)"""

PKT = "PARTITION BY asset_id ORDER BY date"


def rows(n: int) -> str:
    return f"({PKT} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lr(x: str) -> str:
    """log(1+x) for x > -1, NULL otherwise.

    DuckDB has no log1p; ln(1+x) loses the low bits of small x.  The
    classic correction ln(1+x) * x / ((1+x) - 1) restores log1p accuracy.
    """
    return (
        f"CASE WHEN {x} > -1 THEN CASE WHEN 1 + {x} = 1 THEN {x} "
        f"ELSE ln(1 + {x}) * {x} / ((1 + {x}) - 1) END END"
    )


def momentum_cte(
    name: str,
    src: str,
    series: str,
    lookback: int = 230,
    skip: int = 21,
    vol: int | None = None,
) -> str:
    """CTE ``name`` = src.* plus column ``sig`` (sliding frames, no prefix sums)."""
    rs = f"CASE WHEN count({lr(series)}) OVER {rows(lookback)} = {lookback} THEN sum({lr(series)}) OVER {rows(lookback)} END"
    if vol:
        sd = (
            f"CASE WHEN count({series}) OVER {rows(vol)} = {vol} "
            f"THEN stddev_samp({series}) OVER {rows(vol)} END"
        )
        rs = f"({rs}) / NULLIF({sd}, 0)"
    return f"""
{name}_a AS (SELECT *, {rs} AS raw_sig FROM {src}),
{name} AS (SELECT *, lag(raw_sig, {skip}) OVER ({PKT}) AS sig FROM {name}_a)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# ------------------------------------------------------------ basic pieces


def panel_scan() -> str:
    return with_ctes(PANEL) + f"""
SELECT date, asset_id, {rnd('price', 10)} AS price, {rnd('"return"', 8)} AS "return",
       {rnd('specific_return', 8)} AS specific_return, {rnd('specific_risk', 8)} AS specific_risk,
       {rnd('predicted_beta')} AS predicted_beta
FROM panel"""


def factor_join_left() -> str:
    return with_ctes(PANEL, FACTORS) + f"""
SELECT p.date, p.asset_id, {rnd('p."return"', 12)} AS "return",
       {rnd('f.mkt_rf', 10)} AS mkt_rf, {rnd('f.smb', 10)} AS smb, {rnd('f.hml', 10)} AS hml,
       {rnd('f.rmw', 10)} AS rmw, {rnd('f.cma', 10)} AS cma, {rnd('f.rf', 10)} AS rf
FROM panel p LEFT JOIN factors f ON p.date = f.date"""


def excess_return() -> str:
    return with_ctes(PANEL, FACTORS) + f"""
SELECT p.date, p.asset_id, {rnd('p."return" - f.rf', 8)} AS return_rf, 1.0::DOUBLE AS const
FROM panel p LEFT JOIN factors f ON p.date = f.date"""


def signal_only(series: str, name: str, lookback=230, skip=21, vol=None) -> str:
    return with_ctes(PANEL, momentum_cte("s", "panel", f'"{series}"', lookback, skip, vol)) + f"""
SELECT date, asset_id, {rnd('sig')} AS {name} FROM s WHERE sig IS NOT NULL"""


# ------------------------------------------------- signal -> alpha -> IC

PRICE_MIN = 500.0
IC = 0.05


def staged(signal_cte: str, src: str = "s") -> list[str]:
    """Given a CTE with ``sig``, add prev price, forward return, filter, z-score, alpha."""
    return [
        signal_cte,
        f"""
st AS (SELECT *, lag(price, 1) OVER ({PKT}) AS prev_price,
              lead("return", 1) OVER ({PKT}) AS fwd_return FROM {src})""",
        f"""
filt AS (SELECT * FROM st WHERE prev_price > {PRICE_MIN} AND sig IS NOT NULL
         AND predicted_beta IS NOT NULL AND specific_risk IS NOT NULL)""",
        """
z AS (SELECT *, (sig - avg(sig) OVER (PARTITION BY date))
                / NULLIF(stddev_samp(sig) OVER (PARTITION BY date), 0) AS score FROM filt)""",
        f"""
al AS (SELECT *, score * {IC} * specific_risk AS alpha FROM z)""",
    ]


def momentum_stage(series='"return"', lookback=230, skip=21, vol=None) -> str:
    return momentum_cte("s", "panel", series, lookback, skip, vol)


def universe_filter() -> str:
    return with_ctes(PANEL, *staged(momentum_stage())[:3]) + f"""
SELECT date, asset_id, {rnd('prev_price', 10)} AS prev_price, {rnd('sig')} AS momentum FROM filt"""


def zscore() -> str:
    return with_ctes(PANEL, *staged(momentum_stage())[:4]) + f"""
SELECT date, asset_id, {rnd('score')} AS score FROM z"""


def alpha(series='"return"', lookback=230, skip=21, vol=None, panel=None) -> str:
    return with_ctes(panel or PANEL, *staged(momentum_stage(series, lookback, skip, vol))) + f"""
SELECT date, asset_id, {rnd('alpha', 8)} AS alpha, {rnd('predicted_beta')} AS predicted_beta FROM al"""


def forward_returns() -> str:
    return with_ctes(PANEL) + f"""
, fw AS (SELECT date, asset_id, lead("return", 1) OVER ({PKT}) AS fwd_return FROM panel)
SELECT date, asset_id, {rnd('fwd_return', 8)} AS fwd_return FROM fw WHERE fwd_return IS NOT NULL"""


def _ic_base() -> list[str]:
    return [
        PANEL,
        *staged(momentum_stage()),
        """
m AS (SELECT date, asset_id, round(alpha, 10) AS a, round(fwd_return, 10) AS r
      FROM al WHERE alpha IS NOT NULL AND fwd_return IS NOT NULL)""",
    ]


def _ic_value(a: str, r: str) -> str:
    return f"covar_samp({a}, {r}) / NULLIF(stddev_samp({a}) * stddev_samp({r}), 0)"


def _rank(v: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY date ORDER BY {v}) + "
        f"count(*) OVER (PARTITION BY date ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"
    )


def ic_pearson() -> str:
    return with_ctes(*_ic_base()) + f"""
SELECT date, count(*) AS n, {rnd(_ic_value('a', 'r'))} AS ic FROM m GROUP BY date"""


def _ic_rank_cte() -> str:
    return f"""
rk AS (SELECT date, {_rank('a')} AS ra, {_rank('r')} AS rr FROM m),
icr AS (SELECT date, count(*) AS n, {_ic_value('ra', 'rr')} AS ic FROM rk GROUP BY date)"""


def ic_rank() -> str:
    return with_ctes(*_ic_base(), _ic_rank_cte()) + f"""
SELECT date, n, {rnd('ic')} AS ic FROM icr"""


def ic_rolling22() -> str:
    return with_ctes(*_ic_base(), _ic_rank_cte()) + f"""
SELECT date, {rnd('ic')} AS ic,
  {rnd("CASE WHEN count(ic) OVER (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) = 22 THEN avg(ic) OVER (ORDER BY date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) END")} AS ic_rolling
FROM icr"""


def ic_cumulative() -> str:
    return with_ctes(*_ic_base(), _ic_rank_cte()) + f"""
SELECT date, {rnd('ic')} AS ic,
  {rnd('sum(ic) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS ic_cumulative
FROM icr"""


# ------------------------------------------------------------ rolling OLS

OLS_WINDOW = 252


def _det(m: list[list[str]]) -> str:
    """Leibniz expansion of a small symbolic determinant."""
    k = len(m)
    terms = []
    for perm in itertools.permutations(range(k)):
        inv = sum(1 for i in range(k) for j in range(i + 1, k) if perm[i] > perm[j])
        sign = "-" if inv % 2 else "+"
        terms.append(sign + "*".join(m[i][perm[i]] for i in range(k)))
    return "(" + "".join(terms) + ")"


def rolling_ols_ctes(xs: list[str], window: int = OLS_WINDOW, src: str = "fj", tag: str = "") -> list[str]:
    """CTEs ``{tag}ols_m`` (window moments) and ``{tag}ols`` (src.* + B{tag}_const, B{tag}_<x>)."""
    k = len(xs)
    w = rows(window)
    t = tag
    valid = " AND ".join(["return_rf IS NOT NULL"] + [f"{x} IS NOT NULL" for x in xs])
    mom = [f"count(CASE WHEN {valid} THEN 1 END) OVER {w} AS {t}ols_n"]
    mom.append(f"avg(return_rf) OVER {w} AS {t}m_y")
    for i, x in enumerate(xs):
        mom.append(f"avg({x}) OVER {w} AS {t}m_{i}")
        mom.append(f"covar_pop({x}, return_rf) OVER {w} AS {t}c_{i}_y")
        for j in range(i, k):
            mom.append(f"covar_pop({xs[i]}, {xs[j]}) OVER {w} AS {t}c_{i}_{j}")
    cm = [[f"{t}c_{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]
    det = _det(cm)
    betas = []
    for i in range(k):
        mi = [[(f"{t}c_{r}_y" if c == i else cm[r][c]) for c in range(k)] for r in range(k)]
        betas.append(f"{_det(mi)} / NULLIF({det}, 0)")
    sel = ", ".join(f"CASE WHEN {t}ols_n = {window} THEN {b} END AS B{t}_{x}" for b, x in zip(betas, xs))
    const = f"{t}m_y - (" + " + ".join(f"B{t}_{x} * {t}m_{i}" for i, x in enumerate(xs)) + ")"
    return [
        f"""
{t}ols_m AS (SELECT *, {', '.join(mom)} FROM {src})""",
        f"""
{t}ols_b AS (SELECT *, {sel} FROM {t}ols_m)""",
        f"""
{t}ols AS (SELECT *, CASE WHEN {t}ols_n = {window} THEN {const} END AS B{t}_const FROM {t}ols_b)""",
    ]


FJ = """
fj AS (SELECT p.*, f.mkt_rf, f.smb, f.hml, f.rmw, f.cma, f.rf, p."return" - f.rf AS return_rf
       FROM panel p LEFT JOIN factors f ON p.date = f.date)"""


def rolling_ols(xs: list[str], window: int = OLS_WINDOW) -> str:
    cols = ", ".join(f"{rnd('B_' + x)} AS B_{x}" for x in xs)
    return with_ctes(PANEL, FACTORS, FJ, *rolling_ols_ctes(xs, window)) + f"""
SELECT date, asset_id, {rnd('B_const')} AS B_const, {cols} FROM ols WHERE B_const IS NOT NULL"""


def residual_ctes(xs: list[str], strict: bool = False, window: int = OLS_WINDOW) -> list[str]:
    terms = " + ".join(["coalesce(B_const, 0)"] + [f"coalesce(B_{x} * {x}, 0)" for x in xs])
    res = f"return_rf - ({terms})"
    if strict:
        have = " AND ".join(["B_const IS NOT NULL"] + [f"B_{x} IS NOT NULL" for x in xs])
        res = f"CASE WHEN {have} THEN {res} END"
    return [*rolling_ols_ctes(xs, window), f"""
rs AS (SELECT *, {res} AS residual FROM ols)"""]


def residual_signal(xs, name, lookback=230, skip=21, vol=None, strict=False, window=OLS_WINDOW) -> str:
    ctes = [PANEL, FACTORS, FJ, *residual_ctes(xs, strict, window), momentum_cte("s", "rs", "residual", lookback, skip, vol)]
    return with_ctes(*ctes) + f"""
SELECT date, asset_id, {rnd('sig')} AS {name} FROM s WHERE sig IS NOT NULL"""


CAPM = ["mkt_rf"]
FF3 = ["mkt_rf", "smb", "hml"]
FF5 = ["mkt_rf", "smb", "hml", "rmw", "cma"]

# ------------------------------------------------------------ optimiser

GAMMA = 50.0


def weights_ctes(constraints: tuple[str, ...], src: str = "al", keys: str = "date", gamma: str = str(GAMMA)) -> list[str]:
    """``wts`` (keys, asset_id, weight) by window sums over each key group."""
    beta_ok = " AND predicted_beta IS NOT NULL" if "ZeroBeta" in constraints else ""
    pd_ = f"(PARTITION BY {keys})"
    base = f"""
wb AS (SELECT {keys}, asset_id, alpha, predicted_beta AS beta, {gamma} AS g,
              specific_risk * specific_risk AS d FROM {src}
       WHERE alpha IS NOT NULL AND specific_risk IS NOT NULL AND specific_risk > 0{beta_ok}),
ws AS (SELECT *, sum(1.0 / d) OVER {pd_} AS m00, sum(beta / d) OVER {pd_} AS m01,
              sum(beta * beta / d) OVER {pd_} AS m11, sum(alpha / d) OVER {pd_} AS b0,
              sum(alpha * beta / d) OVER {pd_} AS b1 FROM wb)"""
    cons = set(constraints)
    if not cons:
        w = "SELECT {k}, asset_id, alpha / (g * d) AS weight FROM ws"
    elif cons == {"ZeroInvestment"}:
        w = "SELECT {k}, asset_id, (alpha - b0 / m00) / (g * d) AS weight FROM ws WHERE m00 > 0"
    elif cons == {"ZeroBeta"}:
        w = "SELECT {k}, asset_id, (alpha - (b1 / m11) * beta) / (g * d) AS weight FROM ws WHERE m11 > 0"
    else:
        w = """SELECT {k}, asset_id,
       (alpha - (m11 * b0 - m01 * b1) / det - ((m00 * b1 - m01 * b0) / det) * beta) / (g * d) AS weight
FROM (SELECT *, m00 * m11 - m01 * m01 AS det FROM ws) WHERE det > 1e-9 * m00 * m11"""
    return [base, f"""
wts AS ({w.format(k=keys)})"""]


def mvo(constraints: tuple[str, ...]) -> str:
    return with_ctes(PANEL, *staged(momentum_stage()), *weights_ctes(constraints)) + f"""
SELECT date, asset_id, {rnd('weight', 10)} AS weight FROM wts"""


def portfolio_ctes(keys: str = "date", panel: str = "panel") -> list[str]:
    on = " AND ".join(f"w.{c} = fr.{c}" for c in ["date", "asset_id"])
    gk = ", ".join(f"w.{c}" for c in keys.split(", "))
    return [f"""
fr AS (SELECT date, asset_id, lead("return", 1) OVER ({PKT}) AS forward_return FROM {panel})""", f"""
pr AS (SELECT {gk}, coalesce(sum(w.weight * fr.forward_return), 0.0) AS "return"
       FROM wts w LEFT JOIN fr ON {on} GROUP BY {gk})"""]


def _momentum_portfolio() -> list[str]:
    return [PANEL, *staged(momentum_stage()), *weights_ctes(("ZeroBeta", "ZeroInvestment")), *portfolio_ctes()]


def portfolio_returns_sql() -> str:
    return with_ctes(*_momentum_portfolio()) + f"""
SELECT date, {rnd('"return"', 10)} AS "return" FROM pr"""


def _cum(part: str = "") -> str:
    return (
        f"sum({lr(chr(34) + 'return' + chr(34))}) OVER "
        f"({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100"
    )


def cumulative_sql() -> str:
    return with_ctes(*_momentum_portfolio()) + f"""
SELECT date, {rnd(_cum(), 6)} AS cumulative_return FROM pr"""


def _summary_select(src: str = "pr", by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {sel}{rnd('mean_return', 8)} AS mean_return, {rnd('volatility', 8)} AS volatility,
       {rnd('mean_return / NULLIF(volatility, 0)', 8)} AS sharpe
FROM (SELECT {sel}avg("return") * 252 AS mean_return, stddev_samp("return") * sqrt(252.0) AS volatility
      FROM {src}{grp})"""


def summary_sql() -> str:
    return with_ctes(*_momentum_portfolio()) + _summary_select()


def subsample_summary_sql() -> str:
    rng = "date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'"
    ctes = [PANEL, *staged(momentum_stage()), *weights_ctes(("ZeroBeta", "ZeroInvestment"))]
    ctes.append(f"""
sub AS (SELECT * FROM panel WHERE {rng}),
wsub AS (SELECT * FROM wts WHERE {rng})""")
    ctes.append(f"""
frs AS (SELECT date, asset_id, lead("return", 1) OVER ({PKT}) AS forward_return FROM sub),
prs AS (SELECT w.date, coalesce(sum(w.weight * frs.forward_return), 0.0) AS "return"
        FROM wsub w LEFT JOIN frs ON w.date = frs.date AND w.asset_id = frs.asset_id GROUP BY w.date)""")
    return with_ctes(*ctes) + _summary_select("prs")


def gamma_calibration_sql() -> str:
    return with_ctes(*_momentum_portfolio()) + f"""
SELECT {GAMMA}::DOUBLE AS gamma, {rnd('vol', 8)} AS volatility, 0.05::DOUBLE AS target_volatility,
       {rnd(f'{GAMMA} * vol / 0.05', 8)} AS gamma_star
FROM (SELECT stddev_samp("return") * sqrt(252.0) AS vol FROM pr)"""


def _regression_data(xs: list[str], by: str = "") -> str:
    leads = ", ".join(f"lead({c}, 1) OVER (ORDER BY date) AS {c}" for c in [*xs, "rf"])
    xsel = ", ".join(f"sf.{x} * 100 AS {x}" for x in xs)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in ["y", *xs])
    return f"""
sf AS (SELECT date, {leads} FROM factors),
rd0 AS (SELECT {by}(pr."return" - sf.rf) * 100 AS y, {xsel}
        FROM pr LEFT JOIN sf ON pr.date = sf.date WHERE pr."return" IS NOT NULL),
rd AS (SELECT * FROM rd0 WHERE {nn})"""


def regression_capm_sql() -> str:
    ctes = [*_momentum_portfolio(), FACTORS, _regression_data(["mkt_rf"])]
    ctes.append("""
rg AS (SELECT count(*) AS n, regr_slope(y, mkt_rf) AS b, regr_intercept(y, mkt_rf) AS a,
              regr_sxx(y, mkt_rf) AS sxx, regr_syy(y, mkt_rf) AS syy, regr_sxy(y, mkt_rf) AS sxy,
              avg(mkt_rf) AS mx FROM rd),
rs2 AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM rg)""")
    return with_ctes(*ctes) + f"""
SELECT 'Intercept' AS variable, {rnd('a')} AS coefficient,
       {rnd('a / NULLIF(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 0)')} AS tstat FROM rs2
UNION ALL
SELECT 'mkt_rf', {rnd('b')}, {rnd('b / NULLIF(sqrt(s2 / sxx), 0)')} FROM rs2"""


def _minor(m: list[list[str]], r: int, c: int) -> list[list[str]]:
    return [[m[i][j] for j in range(len(m)) if j != c] for i in range(len(m)) if i != r]


def regression_multi_sql(xs: list[str], by_signal: bool = False) -> str:
    """OLS with intercept and classical t-stats by Cramer's rule on centred moments."""
    k = len(xs)
    by, group = ("signal, ", " GROUP BY signal") if by_signal else ("", "")
    mom = ["count(*) AS n", "avg(y) AS my", "var_pop(y) AS vy"]
    for i, x in enumerate(xs):
        mom.append(f"avg({x}) AS m_{i}")
        mom.append(f"covar_pop({x}, y) AS c_{i}_y")
        for j in range(i, k):
            mom.append(f"covar_pop({xs[i]}, {xs[j]}) AS c_{i}_{j}")
    cm = [[f"c_{min(i, j)}_{max(i, j)}" for j in range(k)] for i in range(k)]
    det = _det(cm)
    betas = []
    for i in range(k):
        mi = [[(f"c_{r}_y" if c == i else cm[r][c]) for c in range(k)] for r in range(k)]
        betas.append(f"{_det(mi)} / NULLIF(det, 0) AS b_{i}")
    # adjugate of the symmetric C: adj_ij = (-1)^(i+j) det(minor_ij)
    adj = []
    for i in range(k):
        for j in range(i, k):
            sign = "-" if (i + j) % 2 else ""
            adj.append(f"{sign}{_det(_minor(cm, i, j))} AS a_{i}_{j}")
    fit = " + ".join(f"b_{i} * c_{i}_y" for i in range(k))
    quad = " + ".join(
        f"{'2 * ' if i != j else ''}m_{i} * m_{j} * a_{i}_{j}" for i in range(k) for j in range(i, k)
    )
    const = "my - (" + " + ".join(f"b_{i} * m_{i}" for i in range(k)) + ")"
    ctes = [*(_long_portfolio() if by_signal else [*_momentum_portfolio(), FACTORS]), _regression_data(xs, by)]
    ctes.append(f"""
mo AS (SELECT {by}{', '.join(mom)} FROM rd{group}),
md AS (SELECT *, {det} AS det FROM mo),
mb AS (SELECT *, {', '.join(betas)}, {', '.join(adj)} FROM md),
ms AS (SELECT *, n * (vy - ({fit})) / (n - {k} - 1) AS s2, {const} AS b_c FROM mb)""")
    rows_ = [
        f"SELECT {by}'Intercept' AS variable, {rnd('b_c')} AS coefficient, "
        f"{rnd(f'b_c / NULLIF(sqrt(s2 * (1.0 / n + ({quad}) / det / n)), 0)')} AS tstat FROM ms"
    ]
    for i, x in enumerate(xs):
        rows_.append(
            f"SELECT {by}'{x}', {rnd(f'b_{i}')}, {rnd(f'b_{i} / NULLIF(sqrt(s2 * a_{i}_{i} / det / n), 0)')} FROM ms"
        )
    return with_ctes(*ctes) + "\n" + "\nUNION ALL\n".join(rows_)


# ------------------------------------------------------ all ten signals

# Name, series, regressors, rolling window, vol-scaled, gamma (study table).
STUDY = [
    ("momentum", '"return"', None, 230, False, 50),
    ("vol_scaled_momentum", '"return"', None, 230, True, 50),
    ("ff3_momentum", "res_t", FF3, 230, False, 60),
    ("ff5_momentum", "res_f", FF5, 230, False, 60),
    ("barra_momentum", "specific_return", None, 230, False, 50),
    ("vol_scaled_barra_momentum", "specific_return", None, 230, True, 43),
    ("vol_scaled_ff3_momentum", "res_t", FF3, 230, True, 60),
    ("vol_scaled_ff5_momentum", "res_f", FF5, 230, True, 60),
    ("capm_momentum", "res_c", CAPM, 232, False, 60),
    ("vol_scaled_capm_momentum", "res_c", CAPM, 230, True, 60),
]


def _resid(tag: str, xs: list[str]) -> str:
    terms = " + ".join([f"coalesce(B{tag}_const, 0)"] + [f"coalesce(B{tag}_{x} * {x}, 0)" for x in xs])
    return f"return_rf - ({terms})"


def long_ctes() -> list[str]:
    ctes = [PANEL, FACTORS, FJ]
    ctes += rolling_ols_ctes(CAPM, src="fj", tag="c")
    ctes += rolling_ols_ctes(FF3, src="cols", tag="t")
    ctes += rolling_ols_ctes(FF5, src="tols", tag="f")
    ctes.append(f"""
rsd AS (SELECT *, {_resid('c', CAPM)} AS res_c, {_resid('t', FF3)} AS res_t, {_resid('f', FF5)} AS res_f FROM fols)""")
    raw = []
    for name, series, _, n, vol, _g in STUDY:
        e = f"CASE WHEN count({lr(series)}) OVER {rows(n)} = {n} THEN sum({lr(series)}) OVER {rows(n)} END"
        if vol:
            e = f"({e}) / NULLIF(CASE WHEN count({series}) OVER {rows(230)} = 230 THEN stddev_samp({series}) OVER {rows(230)} END, 0)"
        raw.append(f"{e} AS raw_{name}")
    ctes.append(f"""
rawsig AS (SELECT date, asset_id, price, "return", predicted_beta, specific_risk, {', '.join(raw)} FROM rsd)""")
    lags = ", ".join(f"lag(raw_{name}, 21) OVER ({PKT}) AS {name}" for name, *_ in STUDY)
    ctes.append(f"""
wide AS (SELECT date, asset_id, predicted_beta, specific_risk,
                lag(price, 1) OVER ({PKT}) AS prev_price, lead("return", 1) OVER ({PKT}) AS fwd_return,
                {lags} FROM rawsig)""")
    names = ", ".join(name for name, *_ in STUDY)
    ctes.append(f"""
lng AS (UNPIVOT wide ON {names} INTO NAME signal VALUE value)""")
    ctes.append(f"""
lfilt AS (SELECT * FROM lng WHERE prev_price > {PRICE_MIN} AND value IS NOT NULL
          AND predicted_beta IS NOT NULL AND specific_risk IS NOT NULL),
lz AS (SELECT *, (value - avg(value) OVER (PARTITION BY date, signal))
                 / NULLIF(stddev_samp(value) OVER (PARTITION BY date, signal), 0) AS score FROM lfilt),
lal AS (SELECT *, score * {IC} * specific_risk AS alpha FROM lz)""")
    return ctes


def gamma_case() -> str:
    whens = " ".join(f"WHEN '{name}' THEN {float(g)}" for name, *_, g in STUDY)
    return f"(CASE signal {whens} END)"


def all_signals_long_sql() -> str:
    return with_ctes(*long_ctes()) + f"""
SELECT date, signal, asset_id, {rnd('alpha', 8)} AS alpha FROM lal"""


def _long_portfolio() -> list[str]:
    return [
        *long_ctes(),
        *weights_ctes(("ZeroBeta", "ZeroInvestment"), src="lal", keys="date, signal", gamma=gamma_case()),
        *portfolio_ctes(keys="date, signal"),
    ]


def portfolio_by_signal_sql() -> str:
    return with_ctes(*_long_portfolio()) + f"""
SELECT date, signal, {rnd('"return"', 10)} AS "return" FROM pr"""


def cumulative_by_signal_sql() -> str:
    return with_ctes(*_long_portfolio()) + f"""
SELECT date, signal, {rnd(_cum('PARTITION BY signal'), 6)} AS cumulative_return FROM pr"""


def summary_by_signal_sql() -> str:
    return with_ctes(*_long_portfolio()) + _summary_select("pr", "signal")


def _rank_by(v: str, part: str) -> str:
    return (
        f"(rank() OVER (PARTITION BY {part} ORDER BY {v}) + "
        f"count(*) OVER (PARTITION BY {part} ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2.0"
    )


def ic_by_signal_sql(method: str) -> str:
    ctes = [*long_ctes(), """
lm AS (SELECT date, signal, round(alpha, 10) AS a, round(fwd_return, 10) AS r
       FROM lal WHERE alpha IS NOT NULL AND fwd_return IS NOT NULL)"""]
    if method == "rank":
        ctes.append(f"""
lr_ AS (SELECT date, signal, {_rank_by('a', 'date, signal')} AS a, {_rank_by('r', 'date, signal')} AS r FROM lm)""")
        src = "lr_"
    else:
        src = "lm"
    return with_ctes(*ctes) + f"""
SELECT date, signal, count(*) AS n, {rnd(_ic_value('a', 'r'))} AS ic FROM {src} GROUP BY date, signal"""


def ic_series_by_signal_sql(column: str) -> str:
    over = "PARTITION BY signal ORDER BY date ROWS BETWEEN"
    value = {
        "ic_rolling": f"CASE WHEN count(ic) OVER ({over} 21 PRECEDING AND CURRENT ROW) = 22 "
        f"THEN avg(ic) OVER ({over} 21 PRECEDING AND CURRENT ROW) END",
        "ic_cumulative": f"sum(ic) OVER ({over} UNBOUNDED PRECEDING AND CURRENT ROW)",
    }[column]
    ctes = [*long_ctes(), f"""
lm AS (SELECT date, signal, round(alpha, 10) AS a, round(fwd_return, 10) AS r
       FROM lal WHERE alpha IS NOT NULL AND fwd_return IS NOT NULL),
lr_ AS (SELECT date, signal, {_rank_by('a', 'date, signal')} AS a, {_rank_by('r', 'date, signal')} AS r FROM lm),
ics AS (SELECT date, signal, {_ic_value('a', 'r')} AS ic FROM lr_ GROUP BY date, signal)"""]
    return with_ctes(*ctes) + f"""
SELECT date, signal, {rnd('ic')} AS ic, {rnd(value)} AS {column} FROM ics"""


def ic_rank_stored_sql() -> str:
    ctes = [PANEL, *staged(momentum_stage()), f"""
lm AS (SELECT date, round(alpha, 10) AS a, round(fwd_return, 10) AS r FROM al
       WHERE alpha IS NOT NULL AND fwd_return IS NOT NULL
       AND date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'),
lr_ AS (SELECT date, {_rank_by('a', 'date')} AS a, {_rank_by('r', 'date')} AS r FROM lm)"""]
    return with_ctes(*ctes) + f"""
SELECT date, count(*) AS n, {rnd(_ic_value('a', 'r'))} AS ic FROM lr_ GROUP BY date"""


def gamma_calibration_by_signal_sql() -> str:
    return with_ctes(*_long_portfolio()) + f"""
SELECT signal, {GAMMA}::DOUBLE AS gamma, {rnd('vol', 8)} AS volatility, 0.05::DOUBLE AS target_volatility,
       {rnd(f'{GAMMA} * vol / 0.05', 8)} AS gamma_star
FROM (SELECT signal, stddev_samp("return") * sqrt(252.0) AS vol FROM pr GROUP BY signal)"""


def regression_capm_by_signal_sql() -> str:
    factors = [] if any(c is FACTORS for c in long_ctes()) else [FACTORS]
    ctes = [*_long_portfolio(), *factors, """
sf AS (SELECT date, lead(mkt_rf, 1) OVER (ORDER BY date) AS mkt_rf, lead(rf, 1) OVER (ORDER BY date) AS rf FROM factors),
rd0 AS (SELECT signal, (pr."return" - sf.rf) * 100 AS y, sf.mkt_rf * 100 AS mkt_rf
        FROM pr LEFT JOIN sf ON pr.date = sf.date WHERE pr."return" IS NOT NULL),
rg AS (SELECT signal, count(*) AS n, regr_slope(y, mkt_rf) AS b, regr_intercept(y, mkt_rf) AS a,
              regr_sxx(y, mkt_rf) AS sxx, regr_syy(y, mkt_rf) AS syy, regr_sxy(y, mkt_rf) AS sxy, avg(mkt_rf) AS mx
       FROM rd0 WHERE y IS NOT NULL AND mkt_rf IS NOT NULL GROUP BY signal),
rs2 AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM rg)"""]
    return with_ctes(*ctes) + f"""
SELECT signal, 'Intercept' AS variable, {rnd('a')} AS coefficient,
       {rnd('a / NULLIF(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 0)')} AS tstat FROM rs2
UNION ALL
SELECT signal, 'mkt_rf', {rnd('b')}, {rnd('b / NULLIF(sqrt(s2 / sxx), 0)')} FROM rs2"""


def mvo_dirty_sql() -> str:
    """The momentum weights on the dirtied panel: a bad field counts as NULL."""
    dirty = """
panel AS (
    SELECT date, asset_id,
        CASE WHEN k % 97 IN (0, 1) THEN NULL ELSE price END AS price,
        CASE WHEN k % 9973 = 7 THEN NULL ELSE "return" END AS "return",
        specific_return,
        CASE WHEN k % 97 IN (4, 5, 6) THEN NULL ELSE specific_risk END AS specific_risk,
        CASE WHEN k % 97 IN (2, 3) THEN NULL ELSE predicted_beta END AS predicted_beta
    FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) + asset_id * 7 AS k FROM clean_panel)
)"""
    sql = mvo(("ZeroBeta", "ZeroInvestment"))
    clean = PANEL.replace("panel AS", "clean_panel AS", 1)
    return sql.replace(PANEL, f"{clean},{dirty}", 1).replace(rnd("weight", 10), rnd("weight", 7))


STYLES = ("size", "activity", "discount")
# Fixed values of the test risk model (upper triangle in the order of STYLES)
STYLE_F = ((0.0004, 0.00006, -0.00004), (0.00006, 0.0001, 0.00003), (-0.00004, 0.00003, 0.0002))


def _inverse3(m) -> list[list[str]]:
    """Entries of the inverse of a 3 x 3 matrix of SQL expressions (or numbers), by cofactors."""
    e = [[f"({x})" for x in row] for row in m]

    def cof(r: int, c: int) -> str:
        (a, b), (x, y) = [i for i in range(3) if i != r], [j for j in range(3) if j != c]
        sign = "-" if (r + c) % 2 else ""
        return f"{sign}({e[a][x]} * {e[b][y]} - {e[a][y]} * {e[b][x]})"

    det = " + ".join(f"{e[0][c]} * ({cof(0, c)})" for c in range(3))
    return [[f"(({cof(c, r)}) / ({det}))" for c in range(3)] for r in range(3)]


def style_weight_ctes() -> list[str]:
    """``fw``: weights with S = X F X' + D by (F^-1 + X'D^-1X)^-1 written out for three factors."""
    inv_f = _inverse3([[f"{v}::DOUBLE" for v in row] for row in STYLE_F])
    vs = ("alpha", "predicted_beta", "1.0")
    sums = [f"sum(x{i} * x{j} / d) AS g{i}{j}" for i in range(3) for j in range(i, 3)]
    sums += [f"sum(x{i} * {v} / d) AS u{i}_{n}" for i in range(3) for n, v in enumerate(vs)]
    sums += [f"sum({vs[a]} * {vs[b]} / d) AS v{a}{b}" for a in range(3) for b in range(a, 3)]
    g = [[f"{inv_f[i][j]} / s + g{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    inv = ", ".join(f"{c} AS n{i}{j}" for i, row in enumerate(_inverse3([[f"m{i}{j}" for j in range(3)] for i in range(3)])) for j, c in enumerate(row))
    z = ", ".join(f"{' + '.join(f'n{i}{j} * u{j}_{n}' for j in range(3))} AS z{i}_{n}" for i in range(3) for n in range(3))

    def inner(a: int, b: int) -> str:
        return f"v{min(a, b)}{max(a, b)} - (" + " + ".join(f"u{i}_{a} * z{i}_{b}" for i in range(3)) + ")"

    return [
        PANEL,
        *staged(momentum_stage()),
        f"""
sx AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS BIGINT) AS asset_id,
              round(ln(sum(l_extendedprice) / sum(l_quantity)), 10) AS x0,
              round(avg(l_quantity) / 50.0::DOUBLE, 10) AS x1, round(avg(l_discount) * 20.0::DOUBLE, 10) AS x2
       FROM lineitem GROUP BY 1, 2),
fb AS (SELECT al.date, al.asset_id, alpha, predicted_beta, specific_risk, specific_risk * specific_risk AS d, x0, x1, x2
       FROM al JOIN sx USING (date, asset_id) WHERE alpha IS NOT NULL AND specific_risk > 0),
fs AS (SELECT date, 1.0::DOUBLE + 0.1::DOUBLE * (date_diff('day', DATE '1970-01-01', date) % 7) AS s, {', '.join(sums)}
       FROM fb GROUP BY date),
fm AS (SELECT *, {', '.join(f'{g[i][j]} AS m{i}{j}' for i in range(3) for j in range(3))} FROM fs),
fi AS (SELECT *, {inv} FROM fm),
fz AS (SELECT *, {z} FROM fi),
fl AS (SELECT *, {inner(1, 1)} AS a11, {inner(1, 2)} AS a12, {inner(2, 2)} AS a22, {inner(1, 0)} AS b1, {inner(2, 0)} AS b2 FROM fz),
fd AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) AS l1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) AS l2
       FROM fl WHERE a11 * a22 - a12 * a12 > 1e-9 * a11 * a22),
fw AS (SELECT date, asset_id, specific_risk, s, x0, x1, x2,
              (alpha - l1 * predicted_beta - l2
               - ({' + '.join(f'x{i} * (z{i}_0 - l1 * z{i}_1 - l2 * z{i}_2)' for i in range(3))})) / ({GAMMA} * d) AS weight
       FROM fb JOIN (SELECT date, s, l1, l2, {', '.join(f'z{i}_{n}' for i in range(3) for n in range(3))} FROM fd) USING (date))""",
    ]


def mvo_factor_risk_full_sql() -> str:
    return with_ctes(*style_weight_ctes()) + f"""
SELECT date, asset_id, {rnd('weight', 8)} AS weight FROM fw"""


def mvo_factor_risk_status_sql() -> str:
    return with_ctes(PANEL, *staged(momentum_stage())) + """
SELECT date, n_assets,
       CASE WHEN n_assets = 0 THEN 'no usable rows' WHEN k = 0 THEN 'no covariance' WHEN k = 1 THEN 'bad covariance'
            WHEN betas < 2 THEN 'degenerate constraints' ELSE 'solved' END AS status
FROM (SELECT date, date_diff('day', DATE '1970-01-01', date) % 6 AS k,
             count(*) FILTER (WHERE ok) AS n_assets, count(DISTINCT predicted_beta) FILTER (WHERE ok) AS betas
      FROM (SELECT *, alpha IS NOT NULL AND specific_risk > 0 AS ok FROM al) GROUP BY date)"""


def mvo_status_dirty_sql() -> str:
    sql = mvo_dirty_sql()
    return sql[: sql.index("\ns AS (")].rstrip().rstrip(",") + """
SELECT date, count(*) AS n_rows, count(*) FILTER (WHERE ok) AS n_usable,
       CASE WHEN count(*) FILTER (WHERE ok) = 0 THEN 'no usable rows'
            WHEN count(DISTINCT predicted_beta) FILTER (WHERE ok) < 2 THEN 'degenerate constraints' ELSE 'solved' END AS status
FROM (SELECT *, "return" * specific_risk IS NOT NULL AND specific_risk > 0 AND predicted_beta IS NOT NULL AS ok FROM panel)
GROUP BY date"""


def ex_ante_risk_full_sql() -> str:
    q = " + ".join(f"{STYLE_F[i][j]}::DOUBLE * s * e{i} * e{j}" for i in range(3) for j in range(3))
    return with_ctes(*style_weight_ctes()) + f"""
SELECT date, {rnd(f'sqrt(252.0 * ({q} + v))', 7)} AS active_risk
FROM (SELECT date, any_value(s) AS s, sum(weight * x0) AS e0, sum(weight * x1) AS e1, sum(weight * x2) AS e2,
             sum(weight * weight * specific_risk * specific_risk) AS v FROM fw GROUP BY date)"""


def gamma_ex_ante_sql() -> str:
    ctes = [PANEL, *staged(momentum_stage()), *weights_ctes(("ZeroBeta", "ZeroInvestment"))]
    return with_ctes(*ctes) + f"""
SELECT date, {rnd('r')} AS active_risk, {rnd(f'{GAMMA} * r / 0.05')} AS gamma_star
FROM (SELECT date, sqrt(252.0 * sum(weight * weight * specific_risk * specific_risk)) AS r
      FROM wts JOIN panel USING (date, asset_id) GROUP BY date)"""


def weights_by_pairs_sql() -> str:
    weights = weights_ctes(("ZeroBeta", "ZeroInvestment"), src="lal", keys="date, signal", gamma=gamma_case())
    return with_ctes(*long_ctes(), *weights) + f"""
SELECT date, signal, asset_id, {rnd('weight', 8)} AS weight FROM wts"""


def panel_scan_universe_sql() -> str:
    return with_ctes(PANEL) + f"""
SELECT date, asset_id, {rnd('price', 10)} AS price, {rnd('"return"', 8)} AS "return" FROM panel WHERE price >= {PRICE_MIN}"""


def gamma_ex_ante_by_signal_sql() -> str:
    ctes = [
        *long_ctes(),
        *weights_ctes(("ZeroBeta", "ZeroInvestment"), src="lal", keys="date, signal", gamma=gamma_case()),
    ]
    return with_ctes(*ctes) + f"""
SELECT signal, {rnd('avg(r)')} AS active_risk, {rnd('avg(r) / 0.05')} AS gamma_star
FROM (SELECT date, signal, sqrt(252.0 * sum(weight * weight * specific_risk * specific_risk)) AS r
      FROM wts JOIN panel USING (date, asset_id) GROUP BY date, signal) GROUP BY signal"""


def subsample_summary_by_signal_sql() -> str:
    rng = "date BETWEEN DATE '1999-01-01' AND DATE '2000-12-31'"
    ctes = [
        *long_ctes(),
        *weights_ctes(("ZeroBeta", "ZeroInvestment"), src="lal", keys="date, signal", gamma=gamma_case()),
        f"""
sub AS (SELECT * FROM panel WHERE {rng}),
wsub AS (SELECT * FROM wts WHERE {rng}),
frs AS (SELECT date, asset_id, lead("return", 1) OVER ({PKT}) AS forward_return FROM sub),
prs AS (SELECT w.date, w.signal, coalesce(sum(w.weight * frs.forward_return), 0.0) AS "return"
        FROM wsub w LEFT JOIN frs ON w.date = frs.date AND w.asset_id = frs.asset_id
        GROUP BY w.date, w.signal)""",
    ]
    return with_ctes(*ctes) + _summary_select("prs", "signal")


def weights_roundtrip_sql() -> str:
    return mvo(("ZeroBeta", "ZeroInvestment"))


def distinct_years_sql() -> str:
    return with_ctes(PANEL, *staged(momentum_stage())) + """
SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM al"""


def oracle_sql() -> dict[str, str]:
    return {
        "panel_scan": panel_scan(),
        "factor_join_left": factor_join_left(),
        "excess_return": excess_return(),
        "momentum": signal_only("return", "momentum"),
        "vol_scaled_momentum": signal_only("return", "vol_scaled_momentum", vol=230),
        "barra_momentum": signal_only("specific_return", "barra_momentum"),
        "vol_scaled_barra_momentum": signal_only("specific_return", "vol_scaled_barra_momentum", vol=230),
        "universe_filter": universe_filter(),
        "zscore": zscore(),
        "alpha": alpha(),
        "forward_returns": forward_returns(),
        "ic_pearson": ic_pearson(),
        "ic_rank": ic_rank(),
        "ic_rolling22": ic_rolling22(),
        "ic_cumulative": ic_cumulative(),
        "rolling_ols_capm": rolling_ols(CAPM),
        "rolling_ols_ff3": rolling_ols(FF3),
        "rolling_ols_ff5": rolling_ols(FF5),
        "capm_momentum": residual_signal(CAPM, "capm_momentum", lookback=232),
        "vol_scaled_capm_momentum": residual_signal(CAPM, "vol_scaled_capm_momentum", vol=230),
        "ff3_momentum": residual_signal(FF3, "ff3_momentum"),
        "vol_scaled_ff3_momentum": residual_signal(FF3, "vol_scaled_ff3_momentum", vol=230),
        "ff5_momentum": residual_signal(FF5, "ff5_momentum"),
        "vol_scaled_ff5_momentum": residual_signal(FF5, "vol_scaled_ff5_momentum", vol=230),
        "ff3_momentum_strict": residual_signal(FF3, "ff3_momentum", strict=True),
        "ff5_momentum_short": residual_signal(FF5, "ff5_momentum", lookback=40, skip=5, window=60),
        "mvo_diag_none": mvo(()),
        "mvo_diag_zero_investment": mvo(("ZeroInvestment",)),
        "mvo_diag_zero_beta": mvo(("ZeroBeta",)),
        "mvo_diag_both": mvo(("ZeroBeta", "ZeroInvestment")),
        "portfolio_returns": portfolio_returns_sql(),
        "cumulative_log_returns": cumulative_sql(),
        "summary": summary_sql(),
        "subsample_summary": subsample_summary_sql(),
        "gamma_calibration": gamma_calibration_sql(),
        "factor_regression_capm": regression_capm_sql(),
        "factor_regression_ff5": regression_multi_sql(FF5),
        "all_signals_long": all_signals_long_sql(),
        "portfolio_returns_by_signal": portfolio_by_signal_sql(),
        "cumulative_by_signal": cumulative_by_signal_sql(),
        "summary_by_signal": summary_by_signal_sql(),
        "weights_roundtrip_partitioned": weights_roundtrip_sql(),
        "distinct_years": distinct_years_sql(),
        "alphas_roundtrip_partitioned": alpha(),
        "portfolio_returns_stored_weights": portfolio_returns_sql(),
        "subsample_summary_by_signal": subsample_summary_by_signal_sql(),
        "ic_rank_by_signal": ic_by_signal_sql("rank"),
        "ic_pearson_by_signal": ic_by_signal_sql("pearson"),
        "ic_rolling_by_signal": ic_series_by_signal_sql("ic_rolling"),
        "ic_cumulative_by_signal": ic_series_by_signal_sql("ic_cumulative"),
        "ic_rank_stored_alphas": ic_rank_stored_sql(),
        "gamma_calibration_by_signal": gamma_calibration_by_signal_sql(),
        "factor_regression_capm_by_signal": regression_capm_by_signal_sql(),
        "mvo_diag_both_dirty": mvo_dirty_sql(),
        "mvo_factor_risk_full": mvo_factor_risk_full_sql(),
        "mvo_factor_risk_status": mvo_factor_risk_status_sql(),
        "mvo_status_dirty": mvo_status_dirty_sql(),
        "ex_ante_risk_full": ex_ante_risk_full_sql(),
        "gamma_ex_ante": gamma_ex_ante_sql(),
        "gamma_ex_ante_by_signal": gamma_ex_ante_by_signal_sql(),
        "weights_by_pairs": weights_by_pairs_sql(),
        "panel_scan_universe": panel_scan_universe_sql(),
        "summary_roundtrip": summary_by_signal_sql(),
        "factor_regression_ff5_by_signal": regression_multi_sql(FF5, by_signal=True),
    }
