import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftpanel.functions import scalars, tails
from driftpanel.operators import infer, ols


def test_t_tail_against_printed_tables():
    # Two-sided 5% and 1% points.
    for df, point, p in [(1, 12.7062, 0.05), (10, 2.228139, 0.05), (30, 2.042272, 0.05), (10, 3.169273, 0.01)]:
        assert tails.t_tail(point, df) == pytest.approx(p, rel=1e-5)
        assert tails.t_quantile(1 - p, df) == pytest.approx(point, rel=1e-5)
    assert tails.t_tail(0.0, 5) == 1.0


def test_t_tail_far_out_matches_published_slopes():
    assert tails.t_tail(0.000269 / 3.82e-05, 83223) == pytest.approx(1.9e-12, rel=0.05)
    # The slope and its error are printed to two or three digits, which is what limits this one.
    assert tails.t_tail(-0.000094 / 3.89e-05, 83251) == pytest.approx(0.0154, rel=0.05)


@pytest.mark.parametrize("df", [1e6, 1e8, 1e10, 1e12])
def test_tails_at_many_degrees_of_freedom(df):
    for t in (0.5, 1.5, 1.8, 3.0, 6.0):
        # Fisher's expansion about the normal tail.
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        more = (t**3 + t) / (4 * df) + t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / (96 * df**2)
        wanted = math.erfc(t / math.sqrt(2)) + 2 * density * more
        assert tails.t_tail(t, df) == pytest.approx(wanted, rel=1e-10)
        assert tails.f_tail(t * t, 1, df) == pytest.approx(wanted, rel=1e-10)
        # With two degrees above, the tail is a power.
        assert tails.f_tail(t, 2, df) == pytest.approx(math.exp(-df / 2 * math.log1p(2 * t / df)), rel=1e-10)
    point = 1.959963984540054
    assert tails.t_quantile(0.95, df) == pytest.approx(point + (point**3 + point) / (4 * df), rel=1e-10)


def test_studentized_range_at_many_degrees_of_freedom():
    # Two means: the range is sqrt(2) times a normal value.
    assert tails.tukey_tail(3.0 * math.sqrt(2), 2, 1e11) == pytest.approx(tails.t_tail(3.0, 1e11), rel=1e-8)


def test_f_tail_against_printed_tables():
    for df1, df2, point in [(1, 10, 4.964603), (3, 20, 3.098391), (5, 60, 2.368270)]:
        assert tails.f_tail(point, df1, df2) == pytest.approx(0.05, rel=1e-5)
    assert tails.f_tail(4.0, 1, 12) == pytest.approx(tails.t_tail(2.0, 12), rel=1e-12)
    assert tails.f_tail(0.0, 2, 9) == 1.0


def test_studentized_range_against_printed_tables():
    for k, df, point, p in [(2, 10, 3.151, 0.05), (3, 10, 3.877, 0.05), (3, 20, 3.578, 0.05), (4, 60, 3.737, 0.05), (3, 10, 5.270, 0.01)]:
        assert tails.tukey_tail(point, k, df) == pytest.approx(p, rel=4e-3)
        assert tails.tukey_quantile(1 - p, k, df) == pytest.approx(point, abs=1.5e-3)
    assert tails.tukey_quantile(0.95, 3, 1_000_000) == pytest.approx(3.314, abs=1e-3)
    # Two means: q = t * sqrt(2).
    assert tails.tukey_tail(2.5 * math.sqrt(2), 2, 15) == pytest.approx(tails.t_tail(2.5, 15), rel=1e-8)


def test_missing_arguments_give_missing_tails(spark):
    df = spark.createDataFrame([(2.0, 10.0), (None, 10.0), (2.0, None)], "t double, df double")
    out = [r[0] for r in df.select(tails.t_two_sided("t", "df")).collect()]
    assert out[0] == pytest.approx(0.0733880, rel=1e-5) and out[1:] == [None, None]


@pytest.fixture(scope="module")
def cells_data():
    rng = np.random.default_rng(11)
    rows = []
    for i, season in enumerate(("D", "G")):
        for j, buffer in enumerate((500, 1000, 2000)):
            n = 30 + 17 * i + 11 * j
            x = rng.normal(j, 1.0, n)
            y = 0.3 * i - 0.1 * j + (0.2 + 0.1 * i) * x + rng.normal(0, 0.5, n)
            rows += [(season, buffer, float(a), float(b)) for a, b in zip(x, y)]
    return pd.DataFrame(rows, columns=["season", "buffer", "x", "y"])


def rss(y, *columns):
    design = np.column_stack([np.ones(len(y)), *columns])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    return float(((y - design @ beta) ** 2).sum()), design.shape[1]


def test_line_against_least_squares(spark, cells_data):
    df = spark.createDataFrame(cells_data)
    fit = {r["season"]: r for r in ols.ols_by_stratum(df, "y", "x", ["season"]).collect()}
    for season, part in cells_data.groupby("season"):
        slope, intercept = np.polyfit(part["x"], part["y"], 1)
        left, _ = rss(part["y"].to_numpy(), part["x"])
        se = math.sqrt(left / (len(part) - 2) / ((part["x"] - part["x"].mean()) ** 2).sum())
        row = fit[season]
        assert row["slope"] == pytest.approx(slope) and row["intercept"] == pytest.approx(intercept)
        assert row["slope_se"] == pytest.approx(se) and row["n"] == len(part)


def test_line_needs_spread_and_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)], "g string, x double, y double")
    fit = {r["g"]: r for r in ols.ols_by_stratum(df, "y", "x", ["g"]).collect()}
    assert fit["a"]["slope"] is None and fit["b"]["slope"] is None
    assert fit["c"]["slope"] == 2.0 and fit["c"]["slope_se"] is None


def test_seven_models_against_full_designs(spark, cells_data):
    cells = ols.moments(spark.createDataFrame(cells_data), "y", "x", ["season", "buffer"])
    table = {r["model"]: r for r in ols.model_selection(cells, "season", "buffer").collect()}
    y, x = cells_data["y"].to_numpy(), cells_data["x"].to_numpy()
    s = (cells_data["season"] == "G").to_numpy(float)
    b = [(cells_data["buffer"] == v).to_numpy(float) for v in (1000, 2000)]
    designs = {
        "pooled": [x],
        "+season": [x, s],
        "+buffer": [x, *b],
        "+season+buffer": [x, s, *b],
        "*season": [x, s, x * s],
        "*buffer": [x, *b, *[x * c for c in b]],
        "*season*buffer": [
            x, s, *b, x * s, *[x * c for c in b], *[s * c for c in b], *[x * s * c for c in b]
        ],
    }
    n, total = len(y), ((y - y.mean()) ** 2).sum()
    for name, columns in designs.items():
        left, k = rss(y, *columns)
        row = table[name]
        aic = n * (math.log(2 * math.pi) + math.log(left / n) + 1) + 2 * (k + 1)
        assert row["k"] == k and row["n"] == n
        assert row["aic"] == pytest.approx(aic, abs=1e-6)
        assert row["r2"] == pytest.approx(1 - left / total, abs=1e-9)
        assert row["bic"] - row["aic"] == pytest.approx((k + 1) * (math.log(n) - 2))
    assert min(r["delta_aic"] for r in table.values()) == 0


def test_information_criteria_gap_matches_published_table():
    n = 497_901
    for k, aic, bic in [(2, -574_242, -574_209), (3, -635_998, -635_953), (5, -636_388, -636_321), (12, -638_784, -638_639)]:
        assert bic - aic == pytest.approx((k + 1) * (math.log(n) - 2), abs=1.0)


def test_nested_f_against_full_designs(spark, cells_data):
    cells = ols.moments(spark.createDataFrame(cells_data), "y", "x", ["season", "buffer"])
    table = {r["buffer"]: r for r in ols.nested_f(cells, ["buffer"]).collect()}
    for buffer, part in cells_data.groupby("buffer"):
        y, x = part["y"].to_numpy(), part["x"].to_numpy()
        s = (part["season"] == "G").to_numpy(float)
        r0, _ = rss(y, x)
        r1, _ = rss(y, x, s, x * s)
        n = len(y)
        assert (table[buffer]["df1"], table[buffer]["df2"]) == (2, n - 4)
        assert table[buffer]["f"] == pytest.approx(((r0 - r1) / 2) / (r1 / (n - 4)))


def test_nested_df_match_published_sizes(spark):
    rows = [("D", 500, 82_598), ("G", 500, 82_783), ("D", 1000, 82_986), ("G", 1000, 83_056), ("D", 2000, 83_225), ("G", 2000, 83_253)]
    cells = spark.createDataFrame(
        [(s, b, n, 0.1 * i, 0.5, 10.0, 1.0, 5.0) for i, (s, b, n) in enumerate(rows)],
        "season string, buffer int, n long, xbar double, ybar double, sxx double, sxy double, syy double",
    )
    by_buffer = {r["buffer"]: (r["df1"], r["df2"]) for r in ols.nested_f(cells, ["buffer"]).collect()}
    assert by_buffer == {500: (2, 165_377), 1000: (2, 166_038), 2000: (2, 166_474)}
    by_season = {r["season"]: (r["df1"], r["df2"]) for r in ols.nested_f(cells, ["season"]).collect()}
    assert by_season == {"D": (4, 248_803), "G": (4, 249_086)}


def test_paired_t(spark):
    # Sleep data, a classic paired example: mean -1.58, t = -4.0621, df = 9, p = 0.002833.
    a = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0]
    b = [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
    df = spark.createDataFrame([*zip(a, b), (1.0, None)], "a double, b double")
    row = infer.with_t_p(infer.paired_t(df, [("a", "b")])).first()
    assert (row["n"], row["df"]) == (10, 9)
    assert row["mean_diff"] == pytest.approx(-1.58)
    assert row["t"] == pytest.approx(-4.0621, abs=1e-4)
    assert row["p"] == pytest.approx(0.002833, abs=1e-6)
    assert (row["lo"], row["hi"]) == (pytest.approx(-2.4598858, abs=1e-6), pytest.approx(-0.7001142, abs=1e-6))


PLANT = {
    "ctrl": [4.17, 5.58, 5.18, 6.11, 4.50, 4.61, 5.17, 4.53, 5.33, 5.14],
    "trt1": [4.81, 4.17, 4.41, 3.59, 5.87, 3.83, 6.03, 4.89, 4.32, 4.69],
    "trt2": [6.31, 5.12, 5.54, 5.50, 5.37, 5.29, 4.92, 6.15, 5.80, 5.26],
}


@pytest.fixture(scope="module")
def plant(spark):
    return spark.createDataFrame([(g, v) for g, vs in PLANT.items() for v in vs], "g string, v double")


def test_anova(plant):
    # Plant growth data: F(2, 27) = 4.8461, p = 0.01591.
    row = infer.with_f_p(infer.anova_oneway(plant, "v", "g", list(PLANT))).first()
    assert (row["df1"], row["df2"]) == (2, 27)
    assert row["ss_between"] == pytest.approx(3.76634)
    assert row["ss_within"] == pytest.approx(10.49209)
    assert row["f"] == pytest.approx(4.846088, rel=1e-6)
    assert row["p"] == pytest.approx(0.01590996, rel=1e-6)


def test_tukey(plant):
    table = infer.tukey_hsd(infer.tukey_differences(plant, "v", "g", list(PLANT)))
    got = {r["pair"]: (r["diff"], r["lwr"], r["upr"], r["p_adj"]) for r in table.collect()}
    want = {
        "trt1-ctrl": (-0.371, -1.0622161, 0.3202161, 0.3908711),
        "trt2-ctrl": (0.494, -0.1972161, 1.1852161, 0.1979960),
        "trt2-trt1": (0.865, 0.1737839, 1.5562161, 0.0120064),
    }
    for pair, numbers in want.items():
        assert got[pair] == pytest.approx(numbers, abs=2e-6)


def test_empty_level_is_left_out_of_anova(plant):
    row = infer.anova_oneway(plant, "v", "g", [*PLANT, "none"]).first()
    assert (row["df1"], row["df2"]) == (2, 27)


@pytest.mark.parametrize("d,n,mean,sd", [
    (-1.0255, (82_598, 82_783), (-0.0819, 0.0055), (0.1146, 0.0375)),
    (-1.1476, (82_986, 83_056), (-0.0830, 0.0056), (0.1050, 0.0300)),
    (-1.2885, (83_225, 83_253), (-0.0843, 0.0059), (0.0962, 0.0234)),
])
def test_cohens_d_from_published_moments(spark, d, n, mean, sd):
    def level(tag, n, m, s):
        # Half the values one sd above the mean, half below.
        off = F.when(F.col("id") % 2 == 0, s).otherwise(-s)
        return spark.range(n).select(F.lit(tag).alias("season"), (m + off).alias("c"))

    rows = level("D", n[0], mean[0], sd[0]).unionByName(level("G", n[1], mean[1], sd[1]))
    row = infer.cohens_d(rows, "c", "season", "D", "G").first()
    assert row["d"] == pytest.approx(d, abs=1e-4) and row["magnitude"] == "large"


def test_effect_labels(spark):
    df = spark.createDataFrame([(0.0,), (-0.19,), (0.2,), (-0.5,), (0.8,), (None,)], "d double")
    out = [r[0] for r in df.select(scalars.effect_label(F.col("d"))).collect()]
    assert out == ["negligible", "negligible", "small", "medium", "large", None]


def test_mean_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    out = {r["g"]: r for r in infer.mean_ci(df, "v", ["g"]).collect()}
    assert out["a"]["hi"] - out["a"]["mean"] == pytest.approx(1.96 * math.sqrt(2) / math.sqrt(2))
    assert out["b"]["se"] is None
