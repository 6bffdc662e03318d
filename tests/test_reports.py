"""The analyses end to end on source-shaped tables."""

import math

import numpy as np
import pytest

from driftpanel.operators.compose import AGE_GROUPS, RACE_GROUPS
from driftpanel.plans import prepare, reports, tract
from driftpanel.plans.spec import ALL_SCENARIOS, PanelSpec
from driftpanel.session import scratch_path
from driftpanel.sources import tables

UNITS = 48
AGES = [b for bands in AGE_GROUPS.values() for b in bands]
RACES = [b for bands in RACE_GROUPS.values() for b in bands]


@pytest.fixture(scope="module")
def sources(spark):
    rng = np.random.default_rng(8)
    area = rng.uniform(1, 20, UNITS)
    hu = {2010: rng.integers(5, 400, UNITS), 2020: rng.integers(5, 400, UNITS)}
    measures = []
    for season, buffer in ALL_SCENARIOS:
        for u in range(UNITS):
            for year in (2010, 2020):
                y = 0.6 - 0.03 * math.log(hu[year][u] / area[u]) + rng.normal(0, 0.03)
                measures.append((u + 1, year, season, buffer, float(y), float(rng.uniform(0, 1)), float(hu[year][u] * 2.5), float(hu[year][u])))
    block_measures = spark.createDataFrame(measures, tables.BLOCK_PANEL)
    tract_measures = spark.createDataFrame([m[:6] for m in measures], tables.TRACT_PANEL)
    block_areas = spark.createDataFrame([(u + 1, float(area[u])) for u in range(UNITS)], "GEOID20 long, area_ha double")
    tract_areas = spark.createDataFrame(
        [(u + 1, float(area[u]), *[float(hu[y][u] * k) for k in (2.5, 1.0) for y in (2010, 2020)]) for u in range(UNITS)],
        tables.TRACT_AREA,
    )

    def yearly(bands, year):
        schema = "tract20l string, YEAR int, " + ", ".join(f"{b} double" for b in bands)
        return spark.createDataFrame(
            [(f"Tract {u + 1}", year, *[float(v) for v in rng.integers(1, 500, len(bands))]) for u in range(UNITS)], schema
        )

    age = prepare.two_year_counts(yearly(AGES, 2010), yearly(AGES, 2020), (2010, 2020), "age")
    race = prepare.two_year_counts(yearly(RACES, 2010), yearly(RACES, 2020), (2010, 2020), RACES, sep="")
    return {
        "block": prepare.block_panel(block_measures, block_areas).cache(),
        "tract": prepare.tract_panel(tract_measures, tract_areas).cache(),
        "age": age.cache(),
        "race": race.cache(),
    }


BLOCK = PanelSpec(unit="GEOID20", y="NDVI", x="HU_density")
TRACT = PanelSpec(unit="tract", y="NDVI", x="HU_density", zero_policy="drop")


def test_yearly_counts_have_the_declared_columns(sources, spark):
    for name, schema in (("age", tables.age_schema()), ("race", tables.race_schema())):
        assert set(sources[name].columns) == set(spark.createDataFrame([], schema).columns)
        assert sources[name].count() == UNITS


def test_panels_carry_density(sources):
    for name, spec in (("block", BLOCK), ("tract", TRACT)):
        row = sources[name].first()
        assert row["HU_density"] == pytest.approx(row["HU"] / row["area_ha"])
        assert sources[name].count() == UNITS * 12
        assert prepare.level_checks(sources[name], spec).first()["r_pop_hu"] == pytest.approx(1.0)
        assert prepare.buffer_tests(sources[name], spec).count() == 3


def test_shares_sum_to_a_hundred(sources):
    for shares in (prepare.age_shares(sources["age"], (2010, 2020)), prepare.race_shares(sources["race"], (2010, 2020))):
        assert shares.count() == 2 * UNITS
        for row in shares.limit(5).collect():
            assert sum(v for k, v in row.asDict().items() if k.startswith("pct_")) == pytest.approx(100)


def test_block_tables(sources, spark):
    out = reports.block_tables(sources["block"], BLOCK)
    counts = {k: v.count() for k, v in out.items()}
    assert counts["regression_coefficients"] == counts["transitions"] == counts["densification"] == 4
    assert counts["buffer_tukey"] == 3 and counts["buffer_correlations"] == 9
    assert counts["analysis"] == 4 * UNITS and counts["line_baseline"] == 4 * 80
    assert counts["transition_risk"] == 16
    folder = scratch_path(spark, "tables")
    reports.write_tables({"change_summary": out["change_summary"]}, folder)
    back = tables.read_csv(spark, f"{folder}/change_summary", out["change_summary"].schema)
    assert sorted(back.collect()) == sorted(out["change_summary"].collect())


def test_scenario_tables(sources):
    out = reports.scenario_tables(sources["block"], BLOCK)
    counts = {k: v.count() for k, v in out.items()}
    assert counts["model_selection"] == 7 and counts["change_correlations"] == 36
    assert counts["nested_season"] == 3 and counts["nested_buffer"] == 2
    assert counts["regression_coefficients"] == counts["slope_intervals"] == 6


def test_tract_tables(sources):
    demo = tract.demographics(sources["age"], sources["race"], AGE_GROUPS, RACE_GROUPS, (2010, 2020), unit="tract")
    out = reports.tract_tables(sources["tract"], demo, TRACT)
    counts = {k: v.count() for k, v in out.items()}
    assert counts["analysis"] == 2 * UNITS and counts["composition_by_growth"] == 4
    assert counts["change_by_tercile"] == counts["change_by_second_tercile"] == 6
    assert counts["exposure_correlations"] == 24 and counts["growth_correlations"] == 32
    assert counts["race_by_growth"] == 48 and counts["age_by_growth"] == 32
    assert out["growth_summary"].first()["n_units"] == UNITS
    labels = {r["tercile"] for r in out["change_by_second_tercile"].collect()}
    assert labels == {"Low 60+", "Mid 60+", "High 60+"}
