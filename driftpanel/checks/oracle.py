"""SQL for each query, written against the raw tables and independent of the operators."""

from __future__ import annotations

from itertools import combinations

ORACLES: dict[str, str] = {}

B, T = 1996, 2000
SEASONS = ("Dormant_Season", "Growing_Season")
BUFFERS = (500, 1000, 2000)
ALL6 = [(s, b) for s in SEASONS for b in BUFFERS]
BLOCK4 = [("Dormant_Season", 1000)] + [("Growing_Season", b) for b in BUFFERS]
BAND_GROUPS = {"b1_3": (1, 3), "b4_5": (4, 5), "b6_8": (6, 8), "b9_10": (9, 10)}
TYPES = {
    "Economy": "ECONOMY",
    "Large": "LARGE",
    "Medium": "MEDIUM",
    "Promo": "PROMO",
    "Small": "SMALL",
    "Standard_Type": "STANDARD",
}


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def rr(names: str | list[str], digits: int = 6) -> str:
    names = names.split() if isinstance(names, str) else names
    return ", ".join(r(n, n, digits) for n in names)


def digits(names: str, count: int = 8) -> str:
    return ", ".join(f"printf('%.{count - 1}e', {n} + 0.0) AS {n}" for n in names.split())


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def corr(y: str, x: str) -> str:
    return div(f"regr_sxy({y}, {x})", f"sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x}))")


def sql(name: str, select: str, *ctes: str) -> None:
    ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + select


def scenario_filter(pairs) -> str:
    return "(season, buffer) IN (" + ", ".join(f"('{s}', {b})" for s, b in pairs) + ")"


SCENARIO = "replace(season, '_Season', '') || ' ' || buffer || ' m'"


# Panel from lineitem ---------------------------------------------------------------------------


def long_panel(unit: str, years: bool = True) -> list[str]:
    key = {"supplier": "l_suppkey", "part": "l_partkey"}[unit]
    area = {
        "supplier": "SELECT s_suppkey AS unit, 1 + abs(s_acctbal) / 100 AS area_ha FROM supplier",
        "part": "SELECT p_partkey AS unit, CAST(p_size AS DOUBLE) AS area_ha FROM part",
    }[unit]
    where = f"WHERE year(l_shipdate) IN ({B}, {T})" if years else ""
    return [
        f"""cells AS (SELECT {key} AS unit,
  CASE WHEN l_linestatus = 'F' THEN 'Dormant_Season' ELSE 'Growing_Season' END AS season,
  CASE l_returnflag WHEN 'A' THEN 500 WHEN 'N' THEN 1000 ELSE 2000 END AS buffer,
  CAST(year(l_shipdate) AS INTEGER) AS year,
  avg(l_discount) AS y,
  CAST(count(*) FILTER (WHERE l_quantity > 45) AS DOUBLE) AS hu,
  sum(l_quantity) AS pop
  FROM lineitem {where} GROUP BY 1, 2, 3, 4)""",
        f"areas AS ({area})",
        """panel AS (SELECT c.*, area_ha, hu / nullif(area_ha, 0) AS hu_density,
  pop / nullif(area_ha, 0) AS pop_density FROM cells c LEFT JOIN areas USING (unit))""",
    ]


def wide_from(clean: str, name: str, extra: tuple[str, ...] = (), keep: str = "") -> str:
    cols = []
    for value, short in [("logx", "x"), ("y", "y"), *[(e, e) for e in extra]]:
        for p, i in ((B, 0), (T, 1)):
            cols.append(f"max({value}) FILTER (WHERE year = {p}) AS {short}{i}")
    present = " AND ".join(
        f"count({v}) FILTER (WHERE year = {p}) = 1"
        for v in ("logx", "y", *extra)
        for p in (B, T)
    )
    return (
        f"{name} AS (SELECT unit, season, buffer{keep}, {', '.join(cols)} FROM {clean} "
        f"GROUP BY unit, season, buffer{keep} HAVING {present})"
    )


def wide(unit: str, pairs=ALL6) -> list[str]:
    return [
        *long_panel(unit),
        "clean AS (SELECT *, ln(greatest(hu_density, 1e-10)) AS logx FROM panel "
        f"WHERE y IS NOT NULL AND hu_density IS NOT NULL AND {scenario_filter(pairs)})",
        wide_from("clean", "wide"),
    ]


def fit_cte(source: str, name: str, y: str, x: str, by: str) -> str:
    return f"""{name} AS (SELECT {by}, n, slope, ybar - slope * xbar AS intercept,
  sqrt({div(div('greatest(syy - slope * sxy, 0)', 'n - 2'), 'sxx')}) AS slope_se,
  {div('sxy * sxy', 'sxx * syy')} AS r2, n - 2 AS df, xbar, sxx, syy, sxy, low, high,
  greatest(syy - slope * sxy, 0) AS rss FROM (
  SELECT {by}, CAST(regr_count({y}, {x}) AS BIGINT) AS n, regr_avgx({y}, {x}) AS xbar,
  regr_avgy({y}, {x}) AS ybar, regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy,
  regr_syy({y}, {x}) AS syy, min({x}) AS low, max({x}) AS high,
  {div(f'regr_sxy({y}, {x})', f'regr_sxx({y}, {x})')} AS slope
  FROM {source} GROUP BY {by}))"""


def labelled(source: str, fit: str, name: str, cols: str = "w.*") -> list[str]:
    return [
        f"""{name}_res AS (SELECT {cols}, y0 - (intercept + slope * x0) AS resid0,
  intercept + slope * x1 AS pred1, y1 - (intercept + slope * x1) AS resid1,
  (y1 - (intercept + slope * x1)) - (y0 - (intercept + slope * x0)) AS change,
  x1 - x0 AS dx, y1 - y0 AS dy FROM {source} w JOIN {fit} USING (season, buffer))""",
        f"""{name} AS (SELECT *, {SCENARIO} AS scenario, state0 || ' -> ' || state1 AS transition,
  CASE WHEN round(change, 9) > 0 THEN 'Brightened' WHEN round(change, 9) < 0 THEN 'Dimmed'
  ELSE 'No change' END AS direction FROM (
  SELECT *, CASE WHEN round(resid0, 9) >= 0 THEN 'Bright' ELSE 'Dim' END AS state0,
  CASE WHEN round(resid1, 9) >= 0 THEN 'Bright' ELSE 'Dim' END AS state1 FROM {name}_res))""",
    ]


def changes(unit: str, pairs=ALL6) -> list[str]:
    return [
        *wide(unit, pairs),
        fit_cte("wide", "fit", "y0", "x0", "season, buffer"),
        *labelled("wide", "fit", "ch"),
    ]


S, P = "supplier", "part"
PANEL_COLS = "unit, season, buffer, year"

sql(
    "csv_roundtrip",
    f"SELECT {PANEL_COLS}, {rr('y hu pop area_ha hu_density pop_density')} FROM panel",
    *long_panel(S),
)
sql(
    "scenario_grid",
    "SELECT season, buffer, CAST(count(*) AS BIGINT) AS n FROM panel GROUP BY 1, 2 ORDER BY 1, 2",
    *long_panel(P),
)
sql(
    "scenario_grid_from_data",
    """SELECT s.season, b.buffer, y.year, CAST(count(p.unit) AS BIGINT) AS n
  FROM (SELECT DISTINCT season FROM panel) s, (SELECT DISTINCT buffer FROM panel) b,
  (SELECT DISTINCT year FROM panel) y LEFT JOIN panel p
  ON p.season = s.season AND p.buffer = b.buffer AND p.year = y.year GROUP BY 1, 2, 3""",
    *long_panel(P, years=False),
)
sql(
    "semi_join_scenarios",
    f"SELECT {PANEL_COLS}, {rr('y hu')} FROM panel WHERE {scenario_filter(BLOCK4)}",
    *long_panel(P),
)
sql(
    "round_report",
    f"SELECT season, buffer, {rr('intercept slope r2', 5)}, printf('%.4f', slope_se) AS se_text FROM fit",
    *wide(P),
    fit_cte("wide", "fit", "y0", "x0", "season, buffer"),
)
sql("project_panel", f"SELECT {PANEL_COLS}, {rr('y')} FROM panel", *long_panel(P))
WIDE_COLS = ", ".join(
    [r("y0", f"y_{B}"), r("y1", f"y_{T}"), r("x0", f"log_hu_density_{B}"),
     r("x1", f"log_hu_density_{T}")]
)
DELTAS = f"{r('x1 - x0', 'delta_log_x')}, {r('y1 - y0', 'delta_y')}"
sql(
    "select_by_pattern", f"SELECT unit, season, buffer, {WIDE_COLS}, {DELTAS} FROM wide", *wide(P)
)


def year_bands(year: int) -> str:
    sums = ", ".join(
        f"coalesce(sum(l_quantity) FILTER (WHERE ceil(l_quantity / 5) = {i}), 0) AS band{i}_{year}"
        for i in range(1, 11)
    )
    return (
        f"bands{year} AS (SELECT l_partkey AS tract20l, {sums} FROM lineitem "
        f"WHERE year(l_shipdate) = {year} GROUP BY 1)"
    )


BAND_NAMES = [f"band{i}_{y}" for y in (B, T) for i in range(1, 11)]
sql(
    "suffix_full_join",
    f"SELECT tract20l, {rr(BAND_NAMES)} FROM bands{B} FULL JOIN bands{T} USING (tract20l)",
    year_bands(B),
    year_bands(T),
)
sql(
    "density_join",
    f"SELECT {PANEL_COLS}, {rr('area_ha hu_density pop_density')} FROM panel",
    *long_panel(P),
)
sql(
    "normalize_id",
    "SELECT c_custkey, TRY_CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS id FROM customer",
)
_WHOLE = "CAST(abs(round(c_acctbal)) AS BIGINT)"
sql(
    "normalize_id_numeric",
    f"SELECT c_custkey, {_WHOLE} AS real, CAST(c_custkey AS BIGINT) AS whole, {_WHOLE} AS exact FROM customer",
)
sql("distinct_sorted", "SELECT DISTINCT season, buffer FROM panel ORDER BY 1, 2", *long_panel(P))
CLEAN = f"year IN ({B}, {T}) AND y IS NOT NULL AND hu_density IS NOT NULL"
sql(
    "clean_panel",
    f"SELECT {PANEL_COLS}, {rr('y')}, {r('ln(greatest(hu_density, 1e-10))', 'log_hu_density')} "
    f"FROM panel WHERE {CLEAN}",
    *long_panel(P, years=False),
)
sql(
    "clean_panel_drop_zero",
    f"SELECT {PANEL_COLS}, {rr('y')}, {r('ln(hu_density)', 'log_hu_density')} FROM "
    f"(SELECT * FROM panel WHERE {CLEAN} AND hu_density > 0)",
    *long_panel(P, years=False),
)
sql("panel_wide", f"SELECT unit, season, buffer, {WIDE_COLS} FROM wide", *wide(P))
sql(
    "panel_counts",
    "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT unit) AS BIGINT) AS n_units FROM wide",
    *wide(P, BLOCK4),
)
sql(
    "buffer_wide",
    "SELECT unit, year, season, "
    + ", ".join(r(f"max(y) FILTER (WHERE buffer = {b})", f"b{b}") for b in BUFFERS)
    + " FROM panel GROUP BY 1, 2, 3",
    *long_panel(P),
)
SEASON_WIDE = (
    "sw AS (SELECT unit, buffer, "
    + ", ".join(
        f"max(y{i}) FILTER (WHERE season = '{s}') AS y_{p}_{s}"
        for i, p in ((0, B), (1, T))
        for s in SEASONS
    )
    + " FROM wide GROUP BY 1, 2 HAVING count(DISTINCT season) = 2)"
)
SEASON_COLS = [f"y_{p}_{s}" for p in (B, T) for s in SEASONS]
sql("season_wide", f"SELECT unit, buffer, {rr(SEASON_COLS)} FROM sw", *wide(P), SEASON_WIDE)
sql(
    "cross_season_corr",
    f"SELECT buffer, CAST(count(*) AS BIGINT) AS n, "
    + ", ".join(r(corr(f"y_{p}_{SEASONS[0]}", f"y_{p}_{SEASONS[1]}"), f"r_{p}") for p in (B, T))
    + " FROM sw GROUP BY 1",
    *wide(P),
    SEASON_WIDE,
)
G_COLS = [f"g_{s}_{b}" for s, b in ALL6]
CHANGE_WIDE = (
    "cw AS (SELECT unit, "
    + ", ".join(
        f"max(change) FILTER (WHERE season = '{s}' AND buffer = {b}) AS g_{s}_{b}" for s, b in ALL6
    )
    + " FROM ch GROUP BY 1 HAVING count(*) = 6)"
)
sql("change_wide", f"SELECT unit, {rr(G_COLS)} FROM cw", *changes(S), CHANGE_WIDE)
sql(
    "change_corr_matrix",
    " UNION ALL ".join(
        f"SELECT CAST(count(*) AS BIGINT) AS n, '{a}' AS \"row\", '{b}' AS \"column\", "
        f"{r(corr(a, b), 'r')} FROM cw"
        for a in G_COLS
        for b in G_COLS
    ),
    *changes(S),
    CHANGE_WIDE,
)

B_COLS = [f"b{b}" for b in BUFFERS]
sql(
    "change_corr_matrix_growing",
    " UNION ALL ".join(
        f"SELECT CAST(count(*) AS BIGINT) AS n, '{a}' AS \"row\", '{b}' AS \"column\", "
        f"{r(corr(a, b), 'r')} FROM gw"
        for a in B_COLS
        for b in B_COLS
    ),
    *changes(S, BLOCK4),
    "gw AS (SELECT unit, "
    + ", ".join(f"max(change) FILTER (WHERE buffer = {b}) AS b{b}" for b in BUFFERS)
    + " FROM ch WHERE season = 'Growing_Season' GROUP BY 1 HAVING count(*) = 3)",
)


# Baseline line and change ----------------------------------------------------------------------

FIT = fit_cte("wide", "fit", "y0", "x0", "season, buffer")
sql(
    "ols_by_stratum",
    f"SELECT season, buffer, {rr('intercept slope slope_se r2')}, n, "
    f"{r(div('slope', 'slope_se'), 't')}, df FROM fit",
    *wide(P),
    FIT,
)

# Tail areas by Simpson's rule after t = sqrt(df) tan(a) and f = df2 / df1 tan(a)^2: both
# densities become powers of sine and cosine on [0, pi/2], and their constants cancel.
_N = 4000


def tail(angle: str, sin_power: str, cos_power: str) -> str:
    def area(low: str) -> str:
        at = f"({low} + (pi() / 2 - {low}) * i / {_N})"
        weight = f"(CASE WHEN i = 0 OR i = {_N} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        return (
            f"((pi() / 2 - {low}) * list_sum([{weight} * pow(sin({at}), {sin_power}) * "
            f"pow(greatest(cos({at}), 0), {cos_power}) for i in range(0, {_N} + 1)]))"
        )

    return f"({area(angle)} / {area('CAST(0 AS DOUBLE)')})"


def t_tail(t: str, df: str) -> str:
    return tail(f"atan(abs({t}) / sqrt({df}))", "0", f"({df} - 1)")


def f_tail(f: str, df1: str, df2: str) -> str:
    return tail(f"atan(sqrt({f} * {df1} / {df2}))", f"({df1} - 1)", f"({df2} - 1)")


def t_points(source: str) -> str:
    """Two-sided 5% point of t for each df in a table, by halving."""
    middle = "((low + high) / 2)"
    return f"""points AS (SELECT DISTINCT CAST(df AS DOUBLE) AS df, CAST(0 AS DOUBLE) AS low,
  CAST(64 AS DOUBLE) AS high, 0 AS step FROM {source}
  UNION ALL SELECT df, CASE WHEN outside > 0.05 THEN {middle} ELSE low END,
  CASE WHEN outside > 0.05 THEN high ELSE {middle} END, step + 1
  FROM (SELECT *, {t_tail(middle, 'df')} AS outside FROM points WHERE step < 45)),
point AS (SELECT df, {middle} AS t95 FROM points WHERE step = 45)"""


sql(
    "ols_by_stratum_p",
    f"SELECT season, buffer, {r(t_tail('t', 'df'), 'slope_p')} FROM "
    "(SELECT season, buffer, slope / slope_se AS t, CAST(df AS DOUBLE) AS df FROM fit)",
    *wide(P),
    FIT,
)
FIT_DIGITS = f"{digits('intercept slope slope_se r2')}, {digits('t')}, n"
sql(
    "ols_by_stratum_digits",
    f"SELECT season, buffer, {FIT_DIGITS} FROM (SELECT *, {div('slope', 'slope_se')} AS t FROM fit)",
    *wide(P),
    FIT,
)
sql(
    "pseudo_residual",
    f"SELECT unit, season, buffer, {r('resid0', f'resid_{B}')}, {r('pred1', f'pred_{T}')}, "
    f"{r('resid1', f'resid_{T}')}, {r('change', 'change')} FROM ch",
    *changes(P),
)
sql(
    "state_transition",
    f"SELECT unit, season, buffer, state0 AS state_{B}, state1 AS state_{T}, transition, direction FROM ch",
    *changes(P),
)
sql(
    "transition_interpretation",
    """SELECT transition, direction, CASE
  WHEN state0 = 'Bright' AND state1 = 'Bright' AND direction = 'Brightened' THEN 'More bright'
  WHEN state0 = 'Bright' AND state1 = 'Bright' AND direction = 'Dimmed' THEN 'Still bright but declining'
  WHEN state0 = 'Bright' AND state1 = 'Dim' AND direction = 'Dimmed' THEN 'Bad transition'
  WHEN state0 = 'Dim' AND state1 = 'Bright' AND direction = 'Brightened' THEN 'Good transition'
  WHEN state0 = 'Dim' AND state1 = 'Dim' AND direction = 'Brightened' THEN 'Less dim'
  WHEN state0 = 'Dim' AND state1 = 'Dim' AND direction = 'Dimmed' THEN 'More dim'
  END AS interpretation, CAST(count(*) AS BIGINT) AS n FROM ch GROUP BY 1, 2, 3""",
    *changes(P),
)
sql(
    "scenario_label",
    f"""SELECT {SCENARIO} AS scenario, CAST((CASE season WHEN 'Dormant_Season' THEN 0 ELSE 3 END)
  + (CASE buffer WHEN 500 THEN 1 WHEN 1000 THEN 2 ELSE 3 END) AS INTEGER) AS scenario_order,
  CAST(count(*) AS BIGINT) AS n FROM wide GROUP BY season, buffer ORDER BY 2""",
    *wide(P),
)


def summary(by: str, source: str = "ch") -> str:
    return f"""SELECT {by}, CAST(count(*) AS BIGINT) AS n, {r('avg(change)', 'mean_change')},
  {r('stddev_samp(change)', 'sd_change')},
  {r('avg(CASE WHEN round(change, 9) > 0 THEN 1.0 ELSE 0.0 END) * 100', 'pct_brightened')},
  {r('avg(CASE WHEN round(change, 9) < 0 THEN 1.0 ELSE 0.0 END) * 100', 'pct_dimmed')},
  {r('median(change)', 'median_change')} FROM {source} GROUP BY ALL"""


sql("change_summary", summary("season, buffer"), *changes(P))
TRANSITIONS = ["Bright -> Bright", "Bright -> Dim", "Dim -> Bright", "Dim -> Dim"]
sql(
    "transition_table",
    "SELECT season, buffer, "
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE transition = '{t}') AS BIGINT) AS \"{t}\""
        for t in TRANSITIONS
    )
    + " FROM ch GROUP BY 1, 2",
    *changes(P),
)
sql(
    "bright_subset",
    f"SELECT unit, season, buffer, {r('resid0', f'resid_{B}')}, "
    "CAST(state1 = 'Dim' AS INTEGER) AS went_dim FROM ch WHERE state0 = 'Bright'",
    *changes(P, BLOCK4),
)


def binned(source: str, name: str, value: str, probs: list[str], labels: list[str], by: str = ""):
    group = f"GROUP BY {by}" if by else ""
    quantiles = ", ".join(f"quantile_cont(v, {p}) AS q{i}" for i, p in enumerate(probs))
    cases = " ".join(
        f"WHEN v <= q{i + 1} THEN '{label}'" for i, label in enumerate(labels)
    )
    join = f"LEFT JOIN {name}_q USING ({by})" if by else f"CROSS JOIN {name}_q"
    return [
        f"{name}_v AS (SELECT *, round({value}, 9) AS v FROM {source})",
        f"{name}_q AS (SELECT {by + ',' if by else ''} {quantiles} FROM {name}_v {group})",
        f"{name} AS (SELECT * EXCLUDE (v), CASE WHEN v IS NULL THEN NULL {cases} END AS bin "
        f"FROM {name}_v {join})",
    ]


QUART = ["0", "0.25", "0.5", "0.75", "1"]
TERC = ["0", repr(1 / 3), repr(2 / 3), "1"]
DENS = [
    *changes(S, BLOCK4),
    "bright AS (SELECT * FROM ch WHERE state0 = 'Bright')",
    *binned("bright", "dens", "dx", QUART, ["Q1 (least)", "Q2", "Q3", "Q4 (most)"], "scenario"),
]
sql("quantile_bins_grouped", "SELECT unit, scenario, bin AS dens_q FROM dens", *DENS)
sql(
    "transition_risk_by_quartile",
    f"""SELECT scenario, bin AS dens_q, CAST(count(*) AS BIGINT) AS n_bright,
  CAST(sum(CASE WHEN state1 = 'Dim' THEN 1 ELSE 0 END) AS BIGINT) AS n_went_dim,
  {r("avg(CASE WHEN state1 = 'Dim' THEN 1.0 ELSE 0.0 END) * 100", 'pct_went_dim')}
  FROM dens GROUP BY 1, 2""",
    *DENS,
)
DENSFIT = [*changes(P, BLOCK4), fit_cte("ch", "dfit", "change", "dx", "scenario")]
sql("densification_ols", f"SELECT scenario, n, {rr('slope slope_se r2')} FROM dfit", *DENSFIT)
sql(
    "densification_ols_digits",
    f"SELECT scenario, {FIT_DIGITS} FROM (SELECT *, {div('slope', 'slope_se')} AS t FROM dfit)",
    *DENSFIT,
)
sql(
    "densification_ols_p",
    f"SELECT scenario, {r(t_tail('t', 'df'), 'slope_p')} FROM "
    "(SELECT scenario, slope / slope_se AS t, CAST(df AS DOUBLE) AS df FROM dfit)",
    *DENSFIT,
)
sql(
    "trajectory_filter",
    f"SELECT unit, scenario, {r('dy', 'delta_y')}, {r('dx', 'delta_log_x')}, direction FROM ch "
    "WHERE abs(round(dy, 9)) > 0.01 OR abs(round(dx, 9)) > 0.05",
    *changes(P, BLOCK4),
)
sql(
    "group_sample",
    f"SELECT unit, scenario, {WIDE_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY scenario "
    "ORDER BY md5('42:' || unit), unit) AS place FROM ch) WHERE place <= 400",
    *changes(P),
)


# Scenario comparison ---------------------------------------------------------------------------

BANDS_JOINED = [
    year_bands(B),
    year_bands(T),
    f"bands AS (SELECT * FROM bands{B} FULL JOIN bands{T} USING (tract20l))",
]
sql(
    "corr_strict",
    f"""SELECT 'complete' AS input, CAST(count(*) AS BIGINT) AS n, {r(corr('pop', 'hu'), 'r')} FROM panel
  UNION ALL SELECT 'with gaps', CAST(count(*) AS BIGINT), CASE WHEN count(*) =
  count(band1_{B} + band1_{T}) THEN round({corr(f'band1_{B}', f'band1_{T}')}, 6) END FROM bands""",
    *long_panel(P, years=False),
    *BANDS_JOINED,
)
_STRICT = {
    "with gaps": lambda i: (
        f"CASE WHEN count(*) = count(band{i}_{B} + band{i}_{T}) "
        f"THEN {corr(f'band{i}_{B}', f'band{i}_{T}')} END"
    ),
    "filled": lambda i: corr(f"coalesce(band{i}_{B}, 0)", f"coalesce(band{i}_{T}, 0)"),
}
sql(
    "corr_strict_bands",
    " UNION ALL ".join(
        f"SELECT '{name}' AS input, CAST(count(*) AS BIGINT) AS n, "
        + ", ".join(r(made(i), f"r{i}") for i in range(1, 11))
        + " FROM bands"
        for name, made in _STRICT.items()
    ),
    *BANDS_JOINED,
)
sql(
    "level_checks",
    f"""SELECT CAST(count(*) AS BIGINT) AS n, {r(corr('pop', 'hu'), 'r_pop_hu')},
  {r(corr('built', 'y'), 'r_built_y')} FROM panel""",
    *[c.replace("avg(l_discount) AS y,", "avg(l_discount) AS y, avg(l_tax) AS built,") for c in long_panel(P, years=False)],
)
sql(
    "corr_complete",
    "SELECT CAST(count(*) AS BIGINT) AS n, "
    + ", ".join(r(corr(f"band{i}_{B}", f"band{i}_{T}"), f"r{i}") for i in range(1, 11))
    + " FROM bands",
    *BANDS_JOINED,
)


def by_season(unit: str) -> list[str]:
    cols = ", ".join(f"max(change) FILTER (WHERE season = '{s}') AS {s}" for s in SEASONS)
    return [
        *changes(unit),
        f"cs AS (SELECT unit, buffer, {cols} FROM ch GROUP BY 1, 2 HAVING count(*) = 2)",
    ]


sql(
    "cross_season_change_corr",
    f"SELECT buffer, CAST(count(*) AS BIGINT) AS n, {r(corr(*SEASONS), 'r_change')} FROM cs GROUP BY 1",
    *by_season(S),
)
BUFFER_PAIRS = list(combinations(BUFFERS, 2))
sql(
    "cross_buffer_change_corr",
    "SELECT season, CAST(count(*) AS BIGINT) AS n, "
    + ", ".join(r(corr(f"b{a}", f"b{b}"), f"r_{a}_{b}") for a, b in BUFFER_PAIRS)
    + " FROM cb GROUP BY 1",
    *changes(S),
    "cb AS (SELECT unit, season, "
    + ", ".join(f"max(change) FILTER (WHERE buffer = {b}) AS b{b}" for b in BUFFERS)
    + " FROM ch GROUP BY 1, 2 HAVING count(*) = 3)",
)
RSS = "regr_syy(y0, x0) - coalesce(regr_sxy(y0, x0) * regr_sxy(y0, x0) / nullif(regr_sxx(y0, x0), 0), 0)"


def nested(by: str, factor: str) -> list[str]:
    return [
        f"whole AS (SELECT {by}, CAST(count(*) AS BIGINT) AS n, {RSS} AS rss_pooled FROM wide GROUP BY 1)",
        f"parts AS (SELECT {by}, sum(rss) AS rss_split, CAST(count(*) AS BIGINT) AS levels FROM "
        f"(SELECT {by}, {factor}, {RSS} AS rss FROM wide GROUP BY 1, 2) GROUP BY 1)",
        f"nested AS (SELECT {by}, n, 2 * levels - 2 AS df1, n - 2 * levels AS df2, rss_pooled, "
        "rss_split, ((rss_pooled - rss_split) / (2 * levels - 2)) / (rss_split / (n - 2 * levels)) AS f "
        f"FROM whole JOIN parts USING ({by}))",
    ]


for key, by, factor in (("nested_f_season", "buffer", "season"), ("nested_f_buffer", "season", "buffer")):
    sql(
        key,
        f"SELECT {by}, n, df1, df2, {rr('rss_pooled rss_split f')} FROM nested",
        *wide(P),
        *nested(by, factor),
    )
    sql(
        f"{key}_p",
        f"SELECT {by}, {r(f_tail('f', 'df1', 'df2'), 'p')} FROM nested",
        *wide(P),
        *nested(by, factor),
    )


# Residual sums by demeaning within groups (common slope) or by fitting inside them (own slopes).
# The additive model demeans within buffer, then solves the two-variable line on x and season.
def models(unit: str) -> list[str]:
    def within(by: str) -> str:
        over = f"OVER (PARTITION BY {by})"
        return (
            f"(SELECT sum(dy * dy) - pow(sum(dx * dy), 2) / sum(dx * dx) FROM (SELECT "
            f"x0 - avg(x0) {over} AS dx, y0 - avg(y0) {over} AS dy FROM wide))"
        )

    def own(by: str) -> str:
        return f"(SELECT sum(rss) FROM (SELECT {RSS} AS rss FROM wide GROUP BY {by}))"

    return [
        *wide(unit),
        """d2 AS (SELECT sum(dx * dx) AS xx, sum(dx * ds) AS xs, sum(ds * ds) AS ss, sum(dx * dy) AS xy,
  sum(ds * dy) AS sy, sum(dy * dy) AS yy FROM (SELECT
  x0 - avg(x0) OVER (PARTITION BY buffer) AS dx, y0 - avg(y0) OVER (PARTITION BY buffer) AS dy,
  s - avg(s) OVER (PARTITION BY buffer) AS ds FROM (SELECT *, CAST(season = 'Growing_Season' AS DOUBLE)
  AS s FROM wide)))""",
        f"""fits AS (SELECT 1 AS position, 'pooled' AS model, 2 AS k, (SELECT {RSS} FROM wide) AS rss
  UNION ALL SELECT 2, '+season', 3, {within('season')}
  UNION ALL SELECT 3, '+buffer', 4, {within('buffer')}
  UNION ALL SELECT 4, '+season+buffer', 5, yy - (xy * (xy * ss - sy * xs) + sy * (sy * xx - xy * xs))
    / (xx * ss - xs * xs) FROM d2
  UNION ALL SELECT 5, '*season', 4, {own('season')}
  UNION ALL SELECT 6, '*buffer', 6, {own('buffer')}
  UNION ALL SELECT 7, '*season*buffer', 12, {own('season, buffer')})""",
        """scored AS (SELECT position, model, k, n, 1 - rss / syy AS r2,
  n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * (k + 1) AS aic,
  n * (ln(2 * pi()) + ln(rss / n) + 1) + ln(n) * (k + 1) AS bic
  FROM fits, (SELECT CAST(count(*) AS BIGINT) AS n, regr_syy(y0, x0) AS syy FROM wide))""",
    ]


sql(
    "model_selection",
    f"SELECT position, model, k, n, {rr('r2 aic bic')}, {r('aic - min(aic) OVER ()', 'delta_aic')}, "
    f"{r('bic - min(bic) OVER ()', 'delta_bic')} FROM scored",
    *models(P),
)
sql(
    "model_selection_additive2",
    f"SELECT model, k, n, {rr('r2 aic bic')} FROM scored WHERE position = 4",
    *models(S),
)


# Inference -------------------------------------------------------------------------------------


def paired(source: str, pairs: list[tuple[str, str]], by: str = "") -> str:
    lead, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return "paired AS (" + " UNION ALL ".join(
        f"""SELECT {lead}'{a}' AS "first", '{b}' AS "second", n, mean_diff, sd_diff, n - 1 AS df,
  sd_diff / sqrt(n) AS se, mean_diff / (sd_diff / sqrt(n)) AS t FROM (SELECT {lead}
  CAST(count({a} - {b}) AS BIGINT) AS n, avg({a} - {b}) AS mean_diff,
  stddev_samp({a} - {b}) AS sd_diff FROM {source} {group})"""
        for a, b in pairs
    ) + ")"


T_COLS = f'"first", "second", n, {rr("mean_diff sd_diff")}, df, {rr("se t")}'
T_P = f'SELECT "first", "second", {r(t_tail("t", "df"), "p")} FROM paired'
TRIPLES = [
    *long_panel(P, years=False),
    "triples AS (SELECT unit, year, season, "
    + ", ".join(f"max(y) FILTER (WHERE buffer = {b}) AS b{b}" for b in BUFFERS)
    + " FROM panel GROUP BY 1, 2, 3 HAVING count(*) = 3)",
    paired("triples", [(f"b{a}", f"b{b}") for a, b in BUFFER_PAIRS]),
]
sql("paired_t_buffers", f"SELECT {T_COLS} FROM paired", *TRIPLES)
sql("paired_t_buffers_p", T_P, *TRIPLES)
T_CI = (
    f'SELECT "first", "second", {r("mean_diff - t95 * se", "lo")}, {r("mean_diff + t95 * se", "hi")} '
    "FROM paired JOIN point USING (df)"
)
sql("paired_t_buffers_ci", T_CI, *TRIPLES, t_points("paired"))
SEASON_T = [
    *by_season(S),
    "cs1000 AS (SELECT * FROM cs WHERE buffer = 1000)",
    paired("cs1000", [SEASONS]),
]
sql("paired_t_season", f"SELECT {T_COLS} FROM paired", *SEASON_T)
sql("paired_t_season_p", T_P, *SEASON_T)
sql("paired_t_season_ci", T_CI, *SEASON_T, t_points("paired"))
sql(
    "paired_t_season_by_buffer",
    f"SELECT buffer, {T_COLS} FROM paired",
    *by_season(S),
    paired("cs", [SEASONS], "buffer"),
)
GROW = [
    *changes(P, BLOCK4),
    "grow AS (SELECT * FROM ch WHERE season = 'Growing_Season')",
    """lev AS (SELECT buffer, CAST(count(*) AS BIGINT) AS n, avg(change) AS m, var_samp(change) AS v
  FROM grow GROUP BY 1)""",
    """tot AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(count(*) - 1 AS BIGINT) AS df1,
  CAST(sum(n) - count(*) AS BIGINT) AS df2, sum((n - 1) * v) AS ssw,
  sum(n * pow(m - (SELECT avg(change) FROM grow), 2)) AS ssb FROM lev)""",
]
sql(
    "anova_oneway",
    f"SELECT n, df1, df2, {r('ssb', 'ss_between')}, {r('ssw', 'ss_within')}, "
    f"{r('ssb / df1', 'ms_between')}, {r('ssw / df2', 'ms_within')}, "
    f"{r('(ssb / df1) / (ssw / df2)', 'f')} FROM tot",
    *GROW,
)
sql(
    "anova_oneway_p",
    f"SELECT df1, df2, {r(f_tail('((ssb / df1) / (ssw / df2))', 'df1', 'df2'), 'p')} FROM tot",
    *GROW,
)
sql(
    "tukey_hsd_diff",
    f"""SELECT df1 + 1 AS groups, df2, j.buffer || '-' || i.buffer AS pair, {r('j.m - i.m', 'diff')},
  {r('sqrt(ssw / df2 / 2 * (1.0 / i.n + 1.0 / j.n))', 'se')},
  {r('abs(j.m - i.m) / sqrt(ssw / df2 / 2 * (1.0 / i.n + 1.0 / j.n))', 'q')}
  FROM lev i JOIN lev j ON i.buffer < j.buffer, tot""",
    *GROW,
)


# Studentized range of three means. The normal distribution function comes from a table of
# Simpson increments plus a Taylor step; the range and its scale are integrated on even grids.
_NORMAL = """normal AS (SELECT list(cdf ORDER BY i) AS cdf FROM (SELECT i, sum(CASE WHEN i = 0 THEN 0 ELSE
  (exp(-pow((i - 1) / 64.0 - 8, 2) / 2) + 4 * exp(-pow((i - 0.5) / 64.0 - 8, 2) / 2)
   + exp(-pow(i / 64.0 - 8, 2) / 2)) / (6 * 64 * sqrt(2 * pi())) END) OVER (ORDER BY i) AS cdf
  FROM (SELECT CAST(unnest(range(0, 1025)) AS DOUBLE) AS i)))"""


def range_tail(q: str, df: str) -> str:
    z, s = "(i / 64.0 - 8)", f"(1 + (j - 64) / 64.0 * 9 / sqrt(2 * {df}))"
    x = f"({z} - {q} * {s})"
    at = f"least(greatest(round(({x} + 8) * 64), 0), 1024)"
    x0 = f"({at} / 64.0 - 8)"
    step = f"({x} - {x0})"
    phi = "exp(-pow({0}, 2) / 2) / sqrt(2 * pi())"
    below = (
        f"(cdf[CAST({at} AS INTEGER) + 1] + {phi.format(x0)} * ({step} - {x0} * pow({step}, 2) / 2 "
        f"+ (pow({x0}, 2) - 1) * pow({step}, 3) / 6))"
    )
    inner = (
        f"list_sum([{phi.format(z)} * pow(cdf[i + 1] - {below}, 2) for i in range(0, 1025)]) * 3 / 64"
    )
    mass = f"exp(({df} - 1) * ln({s}) - {df} * ({s} * {s} - 1) / 2)"
    return (
        f"(1 - list_sum([{mass} * {inner} for j in range(0, 129)]) "
        f"/ list_sum([{mass} for j in range(0, 129)]))"
    )


sql(
    "tukey_hsd",
    f"""SELECT pair, {r('diff', 'diff')}, {r('diff - q95 * se', 'lwr')}, {r('diff + q95 * se', 'upr')},
  {r(range_tail('q', 'df'), 'p_adj')} FROM pairs, q_point, normal""",
    *GROW,
    _NORMAL,
    """pairs AS (SELECT *, abs(diff) / se AS q FROM (SELECT CAST(df2 AS DOUBLE) AS df,
  j.buffer || '-' || i.buffer AS pair, j.m - i.m AS diff, sqrt(ssw / df2 / 2 * (1.0 / i.n + 1.0 / j.n)) AS se
  FROM lev i JOIN lev j ON i.buffer < j.buffer, tot))""",
    f"""q_points AS (SELECT CAST(df2 AS DOUBLE) AS df, CAST(0 AS DOUBLE) AS low, CAST(16 AS DOUBLE) AS high,
  0 AS step FROM tot
  UNION ALL SELECT df, CASE WHEN outside > 0.05 THEN (low + high) / 2 ELSE low END,
  CASE WHEN outside > 0.05 THEN high ELSE (low + high) / 2 END, step + 1
  FROM (SELECT *, {range_tail('((low + high) / 2)', 'df')} AS outside FROM q_points, normal WHERE step < 36))""",
    "q_point AS (SELECT (low + high) / 2 AS q95 FROM q_points WHERE step = 36)",
)


def effect(by: str, factor: str, a: str, b: str) -> str:
    def stats(v, tag):
        f = f"FILTER (WHERE {factor} = {v})"
        return (
            f"CAST(count(*) {f} AS BIGINT) AS n_{tag}, avg(change) {f} AS mean_{tag}, "
            f"var_samp(change) {f} AS var_{tag}"
        )

    return f"""SELECT {by}, n_a, n_b, {rr('mean_a mean_b d')}, CASE WHEN abs(d) < 0.2 THEN 'negligible'
  WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude
  FROM (SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)) AS d
  FROM (SELECT {by}, {stats(a, 'a')}, {stats(b, 'b')} FROM ch GROUP BY 1))"""


sql(
    "cohens_d",
    effect("buffer", "season", "'Dormant_Season'", "'Growing_Season'"),
    *changes(P),
)
sql("cohens_d_buffer", effect("season", "buffer", "500", "2000"), *changes(P))
sql(
    "mean_ci",
    f"""SELECT scenario, season, buffer, n, {rr('mean se')},
  {r('mean - CAST(1.96 AS DOUBLE) * se', 'lo')}, {r('mean + CAST(1.96 AS DOUBLE) * se', 'hi')} FROM (SELECT scenario, season,
  buffer, CAST(count(*) AS BIGINT) AS n, avg(change) AS mean, stddev_samp(change) / sqrt(count(*)) AS se
  FROM ch GROUP BY 1, 2, 3)""",
    *changes(P, BLOCK4),
)
sql(
    "slope_ci",
    f"SELECT season, buffer, {rr('slope slope_se')}, "
    f"{r('slope - CAST(1.96 AS DOUBLE) * slope_se', 'lo')}, {r('slope + CAST(1.96 AS DOUBLE) * slope_se', 'hi')} FROM fit",
    *wide(P),
    FIT,
)


# Composition -----------------------------------------------------------------------------------


def bands(unit: str) -> list[str]:
    """Units with summed quantity per band group and year, then shares."""
    key = {"supplier": "l_suppkey", "part": "l_partkey"}[unit]
    dim = {"supplier": "SELECT s_suppkey AS unit FROM supplier", "part": "SELECT p_partkey AS unit FROM part"}[unit]
    cols = []
    for i, p in ((0, B), (1, T)):
        here = f"year(l_shipdate) = {p}"
        cols.append(f"coalesce(sum(l_quantity) FILTER (WHERE {here}), 0) AS tot{i}")
        for g, (lo, hi) in BAND_GROUPS.items():
            cols.append(
                f"coalesce(sum(l_quantity) FILTER (WHERE {here} AND ceil(l_quantity / 5) "
                f"BETWEEN {lo} AND {hi}), 0) AS {g}_{i}"
            )
    return [
        f"age_n AS (SELECT d.unit, {', '.join(cols)} FROM ({dim}) d LEFT JOIN lineitem "
        f"ON {key} = d.unit GROUP BY 1)",
        shares("age_n", "age", list(BAND_GROUPS)),
    ]


def types(unit: str) -> list[str]:
    key = {"supplier": "l_suppkey", "part": "l_partkey"}[unit]
    dim = {"supplier": "SELECT s_suppkey AS unit FROM supplier", "part": "SELECT p_partkey AS unit FROM part"}[unit]
    cols = []
    for i, p in ((0, B), (1, T)):
        here = f"year(l_shipdate) = {p}"
        cols.append(f"coalesce(sum(l_quantity) FILTER (WHERE {here}), 0) AS tot{i}")
        for g, t in TYPES.items():
            cols.append(
                f"coalesce(sum(l_quantity) FILTER (WHERE {here} AND p_type = '{t}'), 0) AS {g}_{i}"
            )
    return [
        "typed AS (SELECT l_suppkey, l_partkey, l_shipdate, l_quantity, p_type FROM lineitem "
        "JOIN part ON l_partkey = p_partkey)",
        f"race_n AS (SELECT d.unit, {', '.join(cols)} FROM ({dim}) d LEFT JOIN typed "
        f"ON {key} = d.unit GROUP BY 1)",
        shares("race_n", "race", list(TYPES)),
    ]


def shares(source: str, name: str, groups: list[str]) -> str:
    cols = [f"{g}_{i} / nullif(tot{i}, 0) AS p_{g}_{i}" for g in groups for i in (0, 1)]
    chi = " + ".join(
        f"coalesce(pow(p_{g}_1 - p_{g}_0, 2) / nullif((p_{g}_0 + p_{g}_1) / 2, 0), 0)" for g in groups
    )
    return (
        f"{name} AS (SELECT *, {chi} AS chi_{name} FROM (SELECT unit, tot0, tot1, {', '.join(cols)} "
        f"FROM {source}))"
    )


def long_shares(name: str, groups) -> str:
    return " UNION ALL ".join(
        f"SELECT unit, CAST({p} AS INTEGER) AS year, {r(f'tot{i}', 'total_pop')}, "
        + ", ".join(r(f"p_{g}_{i} * 100", f"pct_{g}") for g in groups)
        + f" FROM {name}"
        for i, p in ((0, B), (1, T))
    )


sql("composition_grouped", long_shares("age", BAND_GROUPS), *bands(P))
sql("composition_share", long_shares("race", TYPES), *types(S))
sql("composition_share_race", long_shares("race", TYPES), *types(P))
sql(
    "head_by_key",
    f"SELECT * FROM ({long_shares('age', BAND_GROUPS)}) WHERE year = {B} ORDER BY unit LIMIT 3",
    *bands(S),
)
sql(
    "delta_chi_grouped",
    f"SELECT unit, {r('tot0', f'total_pop_{B}')}, {r('tot1', f'total_pop_{T}')}, "
    f"{r('chi_age', 'delta_chi_age')} FROM age",
    *bands(P),
)
sql(
    "delta_chi_raw",
    f"SELECT unit, {r('tot0', f'total_race_{B}')}, {r('tot1', f'total_race_{T}')}, "
    f"{r('chi_race', 'delta_chi_race')} FROM race",
    *types(P),
)
sql(
    "composition_delta",
    "SELECT unit, "
    + ", ".join(r(f"(p_{g}_1 - p_{g}_0) * 100", f"delta_pct_{g}") for g in BAND_GROUPS)
    + f", {r('tot1 - tot0', 'delta_pop_age')} FROM age",
    *bands(P),
)

DEMO_COLS: dict[str, str] = {}
for _name, _groups, _total in (("age", BAND_GROUPS, "total_pop"), ("race", TYPES, "total_race")):
    for _i, _p in ((0, B), (1, T)):
        DEMO_COLS[f"{_total}_{_p}"] = f"{_name}.tot{_i}"
    for _g in _groups:
        for _i, _p in ((0, B), (1, T)):
            DEMO_COLS[f"pct_{_g}_{_p}"] = f"{_name}.p_{_g}_{_i} * 100"
    DEMO_COLS[f"delta_chi_{_name}"] = f"{_name}.chi_{_name}"
    for _g in _groups:
        DEMO_COLS[f"delta_pct_{_g}"] = f"({_name}.p_{_g}_1 - {_name}.p_{_g}_0) * 100"
DEMO_COLS["delta_pop_age"] = "age.tot1 - age.tot0"

DEMO = [
    *bands(S),
    *types(S),
    "demo AS (SELECT unit, "
    + ", ".join(f"{e} AS {c}" for c, e in DEMO_COLS.items())
    + " FROM age FULL JOIN race USING (unit))",
]

TOTALS = f"""totals AS (SELECT l_suppkey AS unit, CAST(year(l_shipdate) AS INTEGER) AS year,
  sum(l_quantity) AS pop, CAST(count(*) AS DOUBLE) AS hu FROM lineitem
  WHERE year(l_shipdate) IN ({B}, {T}) GROUP BY 1, 2)"""
TRACT_PANEL = [
    *long_panel(S)[:2],
    TOTALS,
    """tpanel AS (SELECT c.unit, c.season, c.buffer, c.year, c.y, area_ha, t.pop, t.hu,
  t.hu / area_ha AS hu_density FROM cells c LEFT JOIN totals t USING (unit, year)
  LEFT JOIN areas USING (unit) WHERE c.buffer = 1000)""",
]
TRACT = [
    *TRACT_PANEL,
    "tclean AS (SELECT *, ln(hu_density) AS logx FROM tpanel WHERE hu_density > 0)",
    wide_from("tclean", "twide", ("hu", "pop"), ", area_ha"),
    fit_cte("twide", "tfit", "y0", "x0", "season, buffer"),
    *labelled("twide", "tfit", "tch"),
    """trows AS (SELECT t.*, demo.* EXCLUDE (unit), hu1 - hu0 AS delta_hu, pop1 - pop0 AS delta_pop,
  hu0 / area_ha AS hd0, hu1 / area_ha AS hd1 FROM tch t LEFT JOIN demo USING (unit))""",
    "units AS (SELECT * FROM trows WHERE season = 'Dormant_Season')",
]
TRACT = [*DEMO, *TRACT]
sql(
    "unit_year_join",
    f"SELECT unit, season, year, {rr('y area_ha pop hu hu_density')} FROM tpanel",
    *TRACT_PANEL,
)
sql(
    "unpivot_value_year",
    f'SELECT unit, {rr("area_ha")}, year, {rr("pop hu")} FROM totals '
    "LEFT JOIN areas USING (unit)",
    long_panel(S)[1],
    TOTALS,
)
sql(
    "panel_deltas",
    f"SELECT unit, season, {r('dx', 'delta_log_x')}, {r('dy', 'delta_y')}, {rr('delta_hu delta_pop')}, "
    f"{r('hd0', f'hu_density_{B}')}, {r('hd1', f'hu_density_{T}')}, {r('hd1 - hd0', 'delta_hu_density')} "
    "FROM trows",
    *TRACT,
)
sql(
    "demographics_join",
    f"SELECT unit, season, buffer, scenario, transition, {rr('change')}, {rr(list(DEMO_COLS))} FROM trows",
    *TRACT,
)
PCT = [c for c in DEMO_COLS if c.startswith(("pct_", "total_pop", "total_race"))]
HU_POP = ", ".join(
    [r("hu0", f"hu_{B}"), r("hu1", f"hu_{T}"), r("pop0", f"pop_{B}"), r("pop1", f"pop_{T}")]
)
sql(
    "unit_level_slice",
    f"SELECT unit, {rr('area_ha')}, {HU_POP}, {rr('delta_hu delta_pop')}, {rr(PCT)} FROM units",
    *TRACT,
)
sql(
    "growth_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS n_units, {r('sum(hu0)', f'total_hu_{B}')},
  {r('sum(hu1)', f'total_hu_{T}')}, {r('sum(delta_hu)', 'total_delta_hu')},
  {r('avg(CASE WHEN delta_hu > 0 THEN 1.0 ELSE 0.0 END) * 100', 'pct_gained_hu')},
  {r('avg(CASE WHEN delta_hu < 0 THEN 1.0 ELSE 0.0 END) * 100', 'pct_lost_hu')},
  {r('avg(delta_hu)', 'mean_delta_hu')}, {r('sum(pop0)', f'total_pop_{B}')},
  {r('sum(pop1)', f'total_pop_{T}')}, {r('sum(delta_pop)', 'total_delta_pop')},
  {r('quantile_cont(delta_hu, 0.25)', 'q25_delta_hu')}, {r('median(delta_hu)', 'median_delta_hu')},
  {r('quantile_cont(delta_hu, 0.75)', 'q75_delta_hu')} FROM units""",
    *TRACT,
)
GROWTH_LABELS = ["Q1 (least growth)", "Q2", "Q3", "Q4 (most growth)"]
GROWTH = [*TRACT, *binned("units", "growth", "delta_hu", QUART, GROWTH_LABELS)]
sql(
    "quantile_bins_global",
    f"SELECT unit, {rr('delta_hu')}, bin AS growth_q FROM growth",
    *GROWTH,
)
MEANS = [
    c for c in DEMO_COLS if c.startswith(("pct_", "delta_pct_"))
]
sql(
    "composition_by_quartile",
    f"SELECT bin AS growth_q, CAST(count(*) AS BIGINT) AS n_units, {r('avg(delta_hu)', 'mean_delta_hu')}, "
    f"{r('avg(delta_pop_age)', 'mean_delta_pop_age')}, {r('median(delta_hu)', 'median_delta_hu')}, "
    + ", ".join(r(f"avg({c})", f"mean_{c}") for c in MEANS)
    + " FROM growth GROUP BY 1",
    *GROWTH,
)
sql(
    "composition_long",
    " UNION ALL ".join(
        f"SELECT bin AS growth_q, '{p}' AS year, '{g.replace('_', ' ')}' AS \"group\", "
        f"{r(f'avg(pct_{g}_{p})', 'value')} FROM growth GROUP BY 1"
        for p in (B, T)
        for g in TYPES
    ),
    *GROWTH,
)
sql(
    "composition_long_bands",
    " UNION ALL ".join(
        f"SELECT bin AS growth_q, '{p}' AS year, '{g[1:].replace('_', '-')}' AS \"group\", "
        f"{r(f'avg(pct_{g}_{p})', 'value')} FROM growth GROUP BY 1"
        for p in (B, T)
        for g in BAND_GROUPS
    ),
    *GROWTH,
)
sql(
    "composition_summary",
    "SELECT CAST(count(*) AS BIGINT) AS n_units, "
    + ", ".join(r(f"avg({c})", f"mean_{c}") for c in DEMO_COLS if c.startswith("pct_"))
    + f", {r('median(delta_chi_age)', 'median_delta_chi_age')}, "
    f"{r('median(delta_chi_race)', 'median_delta_chi_race')} FROM demo",
    *DEMO,
)


def variables(periods) -> list[str]:
    out = []
    for groups in (TYPES, BAND_GROUPS):
        out += [f"pct_{g}_{p}" for p in periods for g in groups]
        out += [f"delta_pct_{g}" for g in groups]
    return [*out, "delta_chi_age", "delta_chi_race"]


GROWTH_VARS = variables((B, T))
EXPOSURE_VARS = [*variables((T,)), "delta_hu", "delta_pop"]
sql(
    "growth_demo_corr",
    "SELECT CAST(count(*) AS BIGINT) AS n, "
    + ", ".join(r(corr("delta_hu", v), f"cor_dhu_{v}") for v in GROWTH_VARS)
    + " FROM units",
    *TRACT,
)
sql(
    "growth_demo_corr_long",
    " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {r(corr('delta_hu', v), 'r')} FROM units" for v in GROWTH_VARS
    ),
    *TRACT,
)
sql(
    "change_demo_corr",
    "SELECT scenario, CAST(count(change) AS BIGINT) AS n, "
    + ", ".join(r(corr("change", v), f"cor_dghi_{v}") for v in EXPOSURE_VARS)
    + " FROM trows GROUP BY 1",
    *TRACT,
)
sql(
    "corr_table_transposed",
    " UNION ALL ".join(
        f"SELECT 'cor_dghi_{v}' AS variable, "
        + ", ".join(
            r(
                f"(SELECT {corr('change', v)} FROM trows WHERE scenario = '{s}')",
                f'"{s}"',
            )
            for s in ("Dormant 1000 m", "Growing 1000 m")
        )
        for v in EXPOSURE_VARS
    ),
    *TRACT,
)


def terciles(column: str, label: str) -> list[str]:
    names = [f"{k} {label}" for k in ("Low", "Mid", "High")]
    return [*TRACT, *binned("trows", "terc", column, TERC, names)]


def tercile_summary(share: str) -> str:
    return f"""SELECT scenario, bin AS tercile, CAST(count(*) AS BIGINT) AS n,
  {r('avg(change)', 'mean_change')}, {r('stddev_samp(change)', 'sd_change')},
  {r('avg(CASE WHEN round(change, 9) > 0 THEN 1.0 ELSE 0.0 END) * 100', 'pct_brightened')},
  {r(f'avg({share})', f'mean_{share}')}, {r('avg(y0)', f'mean_y_{B}')}, {r('avg(y1)', f'mean_y_{T}')},
  {r('avg(dy)', 'mean_delta_y')}, {r('median(change)', 'median_change')}
  FROM terc WHERE bin IS NOT NULL GROUP BY 1, 2"""


STANDARD = terciles(f"pct_Standard_Type_{T}", "Standard")
sql("change_by_tercile", tercile_summary(f"pct_Standard_Type_{T}"), *STANDARD)
sql(
    "change_by_tercile_b",
    tercile_summary(f"pct_b9_10_{T}"),
    *terciles(f"pct_b9_10_{T}", "9-10"),
)
sql(
    "transition_share_by_tercile",
    f"SELECT *, {r('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY scenario, tercile) * 100', 'pct')} FROM "
    "(SELECT scenario, bin AS tercile, transition, CAST(count(*) AS BIGINT) AS n FROM terc "
    "WHERE bin IS NOT NULL GROUP BY 1, 2, 3)",
    *STANDARD,
)
sql(
    "levels_by_tercile",
    f"""SELECT scenario, bin AS tercile, CAST(count(*) AS BIGINT) AS n, {r('avg(y0)', f'mean_y_{B}')},
  {r('avg(y1)', f'mean_y_{T}')}, {r('avg(dy)', 'mean_delta_y')},
  {r('avg(hd0)', f'mean_hu_density_{B}')}, {r('avg(hd1)', f'mean_hu_density_{T}')},
  {r('avg(delta_hu)', 'mean_delta_hu')} FROM terc WHERE bin IS NOT NULL GROUP BY 1, 2""",
    *STANDARD,
)


# Tract grain and ordered categories ------------------------------------------------------------

sql(
    "tract_ols",
    f"SELECT season, buffer, {digits('intercept slope slope_se r2')}, n, {r(t_tail('t', 'df'), 'slope_p')} FROM "
    "(SELECT * EXCLUDE (df), slope / slope_se AS t, CAST(df AS DOUBLE) AS df FROM tfit)",
    *TRACT,
)
sql("tract_change_summary", summary("season, buffer", "trows"), *TRACT)
sql(
    "tract_transitions",
    "SELECT season, buffer, "
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE transition = '{t}') AS BIGINT) AS \"{t}\"" for t in TRANSITIONS
    )
    + " FROM trows GROUP BY 1, 2",
    *TRACT,
)
TRACT_T = [
    *TRACT,
    "ts AS (SELECT unit, "
    + ", ".join(f"max(change) FILTER (WHERE season = '{s}') AS {s}" for s in SEASONS)
    + " FROM trows GROUP BY 1 HAVING count(change) = 2)",
    paired("ts", [SEASONS]),
    t_points("paired"),
]
sql(
    "tract_paired_t",
    f"""SELECT "first", "second", n, {rr("mean_diff sd_diff")}, df, {rr("se t")}, {r(t_tail('t', 'df'), 'p')},
  {r("mean_diff - t95 * se", "lo")}, {r("mean_diff + t95 * se", "hi")} FROM paired JOIN point USING (df)""",
    *TRACT_T,
)
_SCENARIO_CODES = ["Dormant 500 m", "Dormant 1000 m", "Dormant 2000 m", "Growing 500 m", "Growing 1000 m", "Growing 2000 m"]


def code(column: str, levels: list[str]) -> str:
    return f"CAST(list_position({levels}, {column}) AS INTEGER)"


_TERCILES = ["Low Standard", "Mid Standard", "High Standard"]
sql(
    "tercile_ordered",
    f"""SELECT CAST(row_number() OVER (ORDER BY scenario_code, tercile_code) AS INTEGER) AS place, * FROM (
  SELECT scenario, {code('scenario', _SCENARIO_CODES)} AS scenario_code, bin AS tercile,
  {code('bin', _TERCILES)} AS tercile_code, CAST(count(*) AS BIGINT) AS n,
  {r('avg(change)', 'mean_change')}, {r('median(change)', 'median_change')}
  FROM terc WHERE bin IS NOT NULL GROUP BY 1, 2, 3, 4)""",
    *STANDARD,
)
sql(
    "growth_ordered",
    f"""SELECT CAST(row_number() OVER (ORDER BY growth_q_code NULLS FIRST) AS INTEGER) AS place, * FROM (
  SELECT bin AS growth_q, {code('bin', GROWTH_LABELS)} AS growth_q_code, CAST(count(*) AS BIGINT) AS "all", """
    + ", ".join(
        f"CAST(count(*) FILTER (WHERE transition = '{t}') AS BIGINT) AS \"{t}\"" for t in TRANSITIONS
    )
    + " FROM growth GROUP BY 1, 2)",
    *GROWTH,
)
sql(
    "scenario_ordered",
    f"""SELECT CAST(row_number() OVER (ORDER BY scenario_code) AS INTEGER) AS place, * FROM (
  SELECT scenario, {code('scenario', _SCENARIO_CODES)} AS scenario_code, CAST(sum(n) AS BIGINT) AS n,
  {r('sum(total) / sum(n)', 'mean_change')}, CAST(max(n) AS BIGINT) AS most_common
  FROM (SELECT scenario, transition, count(*) AS n, sum(change) AS total FROM ch GROUP BY 1, 2) GROUP BY 1, 2)""",
    *changes(P),
)


# Chart data and geometry -----------------------------------------------------------------------


def histogram(values: str, round_edges: bool) -> list[str]:
    unit = "pow(10, floor(log10((high - low) / bins)))"
    return [
        f"vals AS ({values})",
        "spread AS (SELECT min(v) AS low, max(v) AS high, ceil(log2(count(*)) + 1) AS bins FROM vals)",
        f"unit AS (SELECT *, (high - low) / bins AS rough, {unit} AS u FROM spread)",
        """step AS (SELECT *, CASE WHEN 2 * u - rough >= 1.5 * (rough - u) THEN u
  WHEN 5 * u - rough >= 2.75 * (rough - 2 * u) THEN 2 * u
  WHEN 10 * u - rough >= 1.5 * (rough - 5 * u) THEN 5 * u ELSE 10 * u END AS w FROM unit)""",
        """edge AS (SELECT w, floor(low / w) * w AS start,
  CAST(ceil(high / w) - floor(low / w) AS INTEGER) AS k FROM step)"""
        if round_edges
        else "edge AS (SELECT rough AS w, low AS start, CAST(bins AS INTEGER) AS k FROM step)",
        """hist AS (SELECT i AS bin, start + (i - 1) * w AS lower, start + i * w AS upper,
  (SELECT count(*) FROM vals WHERE (i = 1 OR v > start + (i - 1) * w + 1e-7 * w)
   AND (i = k OR v <= start + i * w + 1e-7 * w)) AS n
  FROM edge, (SELECT unnest(range(1, 200)) AS i) WHERE i <= k)""",
    ]


HIST = f"SELECT CAST(bin AS INTEGER) AS bin, {rr('lower upper')}, CAST(n AS BIGINT) AS n FROM hist"
sql("histogram", HIST, *histogram("SELECT l_extendedprice AS v FROM lineitem", True))
sql(
    "histogram_log",
    HIST,
    *histogram("SELECT ln(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice > 0", True),
)
sql(
    "histogram_log_density",
    HIST,
    *long_panel(P),
    *histogram("SELECT ln(hu_density) AS v FROM panel WHERE hu_density > 0", True),
)
sql(
    "histogram_even",
    HIST,
    *long_panel(P),
    *histogram("SELECT pop_density AS v FROM panel WHERE pop_density IS NOT NULL", False),
)
sql(
    "smooth_lm",
    f"""SELECT facet, CAST(i AS INTEGER) AS point, {r('x', 'x')},
  {r('intercept + slope * x', 'fit')},
  {r('sqrt(rss / df) * sqrt(CAST(1 AS DOUBLE) / n + (x - xbar) * (x - xbar) / sxx)', 'se')}, df
  FROM (SELECT *, scenario AS facet, low + i * ((high - low) / 79) AS x
  FROM sfit, (SELECT unnest(range(0, 80)) AS i))""",
    *changes(P),
    fit_cte("ch", "sfit", "change", "dx", "scenario"),
)


sql(
    "smooth_lm_band",
    f"""SELECT scenario, CAST(i AS INTEGER) AS point, {r('x', 'x')},
  {r('fit - t95 * se', 'lo')}, {r('fit + t95 * se', 'hi')} FROM (SELECT *, intercept + slope * x AS fit,
  sqrt(rss / df) * sqrt(CAST(1 AS DOUBLE) / n + (x - xbar) * (x - xbar) / sxx) AS se
  FROM (SELECT *, low + i * ((high - low) / 79) AS x
  FROM sfit, (SELECT unnest(range(0, 80)) AS i))) JOIN point USING (df)""",
    *changes(P),
    fit_cte("ch", "sfit", "change", "dy", "scenario"),
    t_points("sfit"),
)


def box(source: str, value: str, by: str) -> str:
    q = ", ".join(f"quantile_cont({value}, {p}) AS {n}" for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75)))
    inside = f"({value} >= q1 - 1.5 * (q3 - q1) AND {value} <= q3 + 1.5 * (q3 - q1))"
    return f"""SELECT {by}, CAST(count(*) AS BIGINT) AS n,
  {r(f'least(min({value}) FILTER (WHERE {inside}), min(q1))', 'whisker_low')}, {r('min(q1)', 'q1')},
  {r('min(q2)', 'median')}, {r('min(q3)', 'q3')},
  {r(f'greatest(max({value}) FILTER (WHERE {inside}), max(q3))', 'whisker_high')},
  CAST(count(*) FILTER (WHERE NOT {inside}) AS BIGINT) AS n_outliers
  FROM {source} JOIN (SELECT {by}, {q} FROM {source} GROUP BY {by}) USING ({by}) GROUP BY {by}"""


sql("boxplot_stats", box("ch", "change", "scenario"), *changes(P))
sql("boxplot_baseline", box("ch", "y0", "scenario"), *changes(P))
sql(
    "boxplot_by_second_tercile",
    box("known", "change", "scenario, tercile"),
    *terciles(f"pct_b9_10_{T}", "9-10"),
    "known AS (SELECT scenario, bin AS tercile, change FROM terc WHERE bin IS NOT NULL)",
)
sql(
    "smooth_facets",
    f"""SELECT scenario, tercile, CAST(i AS INTEGER) AS point, {rr('x fit se')},
  {r('fit - t95 * se', 'lo')}, {r('fit + t95 * se', 'hi')} FROM (SELECT *, intercept + slope * x AS fit,
  sqrt(rss / df) * sqrt(CAST(1 AS DOUBLE) / n + (x - xbar) * (x - xbar) / sxx) AS se
  FROM (SELECT *, low + i * ((high - low) / 19) AS x
  FROM sfit, (SELECT unnest(range(0, 20)) AS i))) JOIN point USING (df)""",
    *STANDARD,
    "known AS (SELECT *, bin AS tercile FROM terc WHERE bin IS NOT NULL)",
    fit_cte("known", "sfit", "change", "delta_hu", "scenario, tercile"),
    t_points("sfit"),
)
sql(
    "boxplot_by_tercile",
    box("known", "y0", "scenario, tercile"),
    *STANDARD,
    "known AS (SELECT scenario, bin AS tercile, y0 FROM terc WHERE bin IS NOT NULL)",
)
sql(
    "facet_long",
    " UNION ALL ".join(
        f"SELECT unit, scenario, {rr('change delta_chi_race')}, 'Δ % {g.replace('_', ' ')}' AS facet, "
        f"{r(f'delta_pct_{g}', 'value')} FROM trows"
        for g in TYPES
    ),
    *TRACT,
)
sql(
    "facet_long_chi",
    " UNION ALL ".join(
        f"SELECT unit, scenario, {rr('change')}, 'Δχ² ({g.title()})' AS facet, "
        f"{r(f'delta_chi_{g}', 'value')} FROM trows"
        for g in ("age", "race")
    ),
    *TRACT,
)
AREA = """area AS (SELECT vec_id AS unit, abs(list_sum([
  CAST(embedding[2 * i + 1] AS DOUBLE) * CAST(embedding[(2 * i + 2) % 64 + 2] AS DOUBLE)
  - CAST(embedding[(2 * i + 2) % 64 + 1] AS DOUBLE) * CAST(embedding[2 * i + 2] AS DOUBLE)
  for i in range(0, 32)])) / 2
  * pow(CAST(1200 AS DOUBLE) / 3937, 2) AS m2 FROM embeddings)"""
for _key in ("polygon_area", "polygon_area_vertices"):
    sql(_key, f"SELECT unit, {r('m2', 'area_m2', 9)}, {r('m2 / 10000', 'area_ha', 13)} FROM area", AREA)
