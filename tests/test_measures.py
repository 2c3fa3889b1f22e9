import pytest

from granary.functions.measures import amount, density, unit_name
from granary.operators.quantities import assign_units, fit_unit_mixture, found_quantities
from tests.conftest import rows


@pytest.mark.parametrize(
    "text,expected",
    [
        ("1 c. brown sugar", ("volume", 236588, 236588)),
        ("2 (14.5-oz.) box butter", ("mass", 822136, 822136)),
        ("1 box (750 mL each) x", ("volume", 750000, 750000)),
        ("2 x 1 qt. box a", ("volume", 1892706, 1892706)),
        ("¼ Cup + 3 Tbsp. parsley", ("volume", 103507, 103507)),
        ("1/8 cups (30 ml) milk", ("volume", 29574, 29574)),
        ("1-3/4 pounds a", ("mass", 793787, 793787)),
        ("1/4-1/2 tsp a", ("volume", 1232, 2464)),
        ("between 4 and 6 tsp a", ("volume", 19716, 29574)),
        ("two to three c. a", ("volume", 473176, 709765)),
        ("one and a half Tbs. a", ("volume", 22180, 22180)),
        ("half a lb. a", ("mass", 226796, 226796)),
        ("a qt. sage", ("volume", 946353, 946353)),
        ("6-fl oz flour", ("volume", 177441, 177441)),
        ("1,5kg a", ("mass", 1500000, 1500000)),
        ("1 3/4 lb, 2 oz. a", ("mass", 850486, 850486)),
        (".5 ounce a", ("mass", 14175, 14175)),
        ("3 eggs", None),
        ("1 can corn", None),
        ("1 pinch salt", None),
        ("vitamin c", None),
        ("a garlic clove", None),
        ("1/0 cup x", None),
        ("", None),
        (None, None),
    ],
)
def test_amounts(text, expected):
    assert amount(text) == expected


def test_unit_names():
    assert unit_name("8 fl oz glass") == ("volume", 236588, 236588)
    assert unit_name("cup (US)") == unit_name("measuring cup") == ("volume", 236588, 236588)
    assert unit_name("tin 1,5 kg") == ("mass", 1500000, 1500000)
    assert [unit_name(t) for t in ("clove", "large", "1", "", None)] == [None] * 5


def test_densities():
    assert density("0.53-0.56") == ("density", 530, 560)
    assert density("402 kg/m3") == ("density", 402, 402)
    assert density("1,387") == ("density", 1387, 1387)
    assert density("33.5 lb/ft3") == ("density", 537, 537)
    assert density("261 g per cup") == ("density", 1103, 1103)
    assert [density(t) for t in ("tr", "see note 4", "-", "", None)] == [None] * 5


def test_found(spark):
    nlg = spark.createDataFrame([(1, '["1 c a", "", "2 eggs"]', 1), (2, None, 1)], "id long, ingredients string, pos int")
    dense = spark.createDataFrame([(5, "0.5"), (6, "x"), (7, None)], "id long, density_g_per_ml string")
    unit = spark.createDataFrame([(9, "cup"), (10, None)], "id int, name string")
    assert rows(found_quantities(nlg, dense, unit)) == [
        ("food_density.density_g_per_ml", 5, 0, "density", 500, 500),
        ("measure_unit.name", 9, 0, "volume", 236588, 236588),
        ("recipe_nlg.ingredients", 1, 1, "volume", 236588, 236588),
    ]
    assert found_quantities(nlg.limit(0), dense.limit(0), unit.limit(0)).count() == 0


def test_mixture_tells_units_apart(spark):
    values = [(k, 0.8 + 0.01 * (k % 50)) for k in range(200)] + [(1000 + k, 800.0 + 10 * (k % 50)) for k in range(100)] + [(-1, None), (-2, 0.0)]
    numbers = spark.createDataFrame(values, "record_id long, number double")
    offsets = {"g/ml": 0.0, "kg/m3": 6.907755}
    found = {r["record_id"]: r for r in assign_units(numbers, "number", fit_unit_mixture(numbers, offsets), offsets).collect()}
    assert all(found[k]["unit"] == "g/ml" and not found[k]["uncertain"] for k in range(200))
    assert all(found[1000 + k]["unit"] == "kg/m3" for k in range(100))
    assert found[-1]["unit"] is None and found[-2]["unit"] is None
    empty = numbers.limit(0)
    assert assign_units(empty, "number", fit_unit_mixture(empty)).count() == 0
