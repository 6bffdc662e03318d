import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from driftpanel.functions.scalars import quoted
from driftpanel.operators import compose
from driftpanel.plans import tract
from driftpanel.sources import tables

GROUPS = {"a": ["x", "y"], "b": ["z"]}
SCHEMA = "tract20l string, x_2010 double, y_2010 double, z_2010 double, x_2020 double, y_2020 double, z_2020 double"


def wide(spark, *rows):
    return spark.createDataFrame([(f"T{i}", *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)], SCHEMA)


def composed(spark, *rows, **kw):
    df = compose.composition_wide(wide(spark, *rows), "tract20l", GROUPS, (2010, 2020), "age", delta_total="delta_pop", **kw)
    return [r for r in df.orderBy("unit").collect()]


def test_shares_and_distance(spark):
    row = composed(spark, (1, 1, 2, 3, 0, 1))[0]
    assert (row["total_pop_2010"], row["pct_a_2010"], row["pct_b_2020"]) == (4.0, 50.0, 25.0)
    assert row["delta_pct_a"] == 25.0 and row["delta_pop"] == 0.0
    want = (0.75 - 0.5) ** 2 / 0.625 + (0.25 - 0.5) ** 2 / 0.375
    assert row["delta_chi_age"] == pytest.approx(want)


def test_empty_total_has_no_share_and_distance_zero(spark):
    row = composed(spark, (0, 0, 0, 3, 0, 1))[0]
    assert row["pct_a_2010"] is None and row["delta_pct_a"] is None
    assert row["delta_chi_age"] == 0.0
    assert composed(spark, (0, 0, 0, 3, 0, 1), empty_as_null=True)[0]["delta_chi_age"] is None


def test_missing_band_makes_the_total_missing(spark):
    row = composed(spark, (None, 1, 2, 3, 0, 1))[0]
    assert row["total_pop_2010"] is None and row["pct_b_2010"] is None
    assert row["pct_a_2020"] == 75.0 and row["delta_chi_age"] == 0.0


def test_group_absent_in_both_periods_adds_nothing(spark):
    assert composed(spark, (1, 1, 0, 3, 3, 0))[0]["delta_chi_age"] == 0.0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 50), min_size=6, max_size=6))
def test_distance_is_symmetric_and_zero_for_equal_shares(spark, counts):
    before, after = counts[:3], counts[3:]
    rows = composed(spark, (*before, *after), (*after, *before), (*before, *[3 * c for c in before]))
    assert rows[0]["delta_chi_age"] == pytest.approx(rows[1]["delta_chi_age"])
    assert rows[2]["delta_chi_age"] == pytest.approx(0.0, abs=1e-12)
    if sum(before):
        assert rows[0]["pct_a_2010"] + rows[0]["pct_b_2010"] == pytest.approx(100.0)


def test_long_form_and_union_form_agree(spark):
    df = wide(spark, (1, 1, 2, 3, 0, 1), (0, 0, 0, 1, 1, 1))
    one = compose.shares_long(df, "tract20l", GROUPS, (2010, 2020)).collect()
    two = compose.shares_by_union(df, "tract20l", GROUPS, (2010, 2020)).collect()
    assert sorted(one, key=str) == sorted(two, key=str)
    assert len(one) == 4


def test_age_and_race_presets(spark):
    age = tables.age_schema()
    race = tables.race_schema()
    assert age.count("double") == 36 and race.count("double") == 12
    ages = spark.createDataFrame([("T1", *[float(i) for i in range(36)])], age)
    races = spark.createDataFrame([("T1", *[float(i + 1) for i in range(12)])], race)
    row = tract.demographics(ages, races, compose.AGE_GROUPS, compose.RACE_GROUPS, (2010, 2020)).first()
    assert row["total_pop_2010"] == sum(range(18))
    assert row["pct_0_19_2010"] == pytest.approx(100 * (0 + 1 + 2 + 3) / sum(range(18)))
    assert row["pct_60p_2020"] == pytest.approx(100 * sum(range(30, 36)) / sum(range(18, 36)))
    assert row["pct_Two_or_More_2010"] == pytest.approx(100 * 5 / 21)
    assert row["delta_pop_age"] == sum(range(18, 36)) - sum(range(18))


def test_demographics_keep_units_of_either_side(spark):
    ages = spark.createDataFrame([("T1", *[1.0] * 36), ("T2", *[1.0] * 36)], tables.age_schema())
    races = spark.createDataFrame([("T2", *[1.0] * 12), ("T3", *[1.0] * 12)], tables.race_schema())
    out = tract.demographics(ages, races, compose.AGE_GROUPS, compose.RACE_GROUPS, (2010, 2020))
    assert sorted(r["unit"] for r in out.collect()) == [1, 2, 3]


def test_quoted_names():
    assert quoted("a`b") == "`a``b`"
