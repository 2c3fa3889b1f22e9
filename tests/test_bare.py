"""Densities without a unit, in every form that measures.density reads."""

import pytest

from granary.functions.measures import bare_density
from granary.operators.quantities import bare_densities

BARE = {"0.5": 0.5, " 0,53 ": 0.53, "0.5-0.6": 0.55, "0.5 to 0.6": 0.55, "0.5 – 0.7": 0.6, "about 0.9": 0.9, "~1.1": 1.1, "≈ 1": 1.0, "ca. 0.8": 0.8, "5.1e-1": 0.51, "5E2": 500.0, "0": 0.0}
OTHER = ["402 kg/m3", "0.5 g/ml", "0.5-0.6 g/cm3", "tr", "-", "", None]


@pytest.mark.parametrize("text,number", BARE.items())
def test_bare_number(text, number):
    assert bare_density(text) == pytest.approx(number)


def test_bare_densities(spark):
    df = spark.createDataFrame(list(enumerate([*BARE, *OTHER])), "id long, density_g_per_ml string")
    found = {r["record_id"]: r["number"] for r in bare_densities(df).collect()}
    assert found == pytest.approx(dict(enumerate(BARE.values())))
