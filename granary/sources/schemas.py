"""Schemas of the source tables.

One line per table: column, ``*`` if it belongs to the primary key, type, ``!`` if it must not be null.
Dates and several numbers are text on purpose: the files hold empty fields and ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}

# The tables and columns of the data model.
TABLES = {
    "food_category": "id* int!, code string!, description string!",
    "measure_unit": "id* int!, name string!",
    "nutrient": "id* int!, name string!, unit_name string, nutrient_nbr string, rank string",
    "retention_factor": "gid* int!, code int!, food_group_id int!, description string!",
    "wweia_food_category": "wweia_food_category* int!, wweia_food_category_description string!",
    "lab_method": "id* int!, description string, technique string",
    "food": "fdc_id* long!, data_type string!, description string, food_category_id string, publication_date string",
    "branded_food": "fdc_id* long!, brand_owner string, brand_name string, subbrand_name string, gtin_upc string, ingredients string, not_a_significant_source_of string, serving_size string, serving_size_unit string, household_serving_fulltext string, branded_food_category string, data_source string, package_weight string, modified_date string, available_date string, market_country string, discontinued_date string, preparation_state_code string, trade_channel string, short_description string, material_code string",
    "foundation_food": "fdc_id* long!, ndb_number string, footnote string",
    "sr_legacy_food": "fdc_id* long!, ndb_number string",
    "sample_food": "fdc_id* long!",
    "survey_fndds_food": "fdc_id* long!, food_code string, wweia_category_code string, start_date string, end_date string",
    "sub_sample_food": "fdc_id* long!, fdc_id_of_sample_food long",
    "food_component": "id* long!, fdc_id long!, name string, pct_weight string, is_refuse string, gram_weight double, data_points string, min_year_acquired string",
    "food_portion": "id* long!, fdc_id long!, seq_num int, amount double, measure_unit_id int, portion_description string, modifier string, gram_weight double, data_points string, footnote string, min_year_acquired string",
    "food_nutrient": "id* long!, fdc_id long!, nutrient_id int!, amount double, data_points string, derivation_id int, min string, max string, median string, loq string, footnote string, min_year_acquired string, percent_daily_value string",
    "food_protein_conversion_factor": "food_nutrient_conversion_factor_id* long!, value double",
    "input_food": "id* long!, fdc_id long!, fdc_id_of_input_food string, seq_num int, amount double, sr_code string, sr_description string, unit string, portion_code string, portion_description string, gram_weight double, retention_code string",
    "market_acquisition": "fdc_id* long!, brand_description string, expiration_date string, label_weight string, location string, acquisition_date string, sales_type string, sample_lot_nbr string, sell_by_date string, store_city string, store_name string, store_state string, upc_code string, acquisition_number string",
    "microbe": "id* int!, food_id long!, method string, microbe_code string, min_value string, max_value string, uom string",
    "lab_method_code": "lab_method_id* int!, code* string!",
    "lab_method_nutrient": "lab_method_id* int!, nutrient_id* int!",
    "sub_sample_result": "food_nutrient_id long!, adjusted_amount string, lab_method_id int, nutrient_name string",
    "fndds_ingredient_nutrient_value": "ingredient_code string, ingredient_description string, nutrient_code string, nutrient_value string, nutrient_value_source string, fdc_id long, derivation_code string, sr_addmod_year string, foundation_year_acquired string, start_date string, end_date string",
    "food_update_log_entry": "id* long!, description string, last_updated string",
    "open_recipe": "id* string!, name string, ingredients string, url string, image string, source string, description string, creator string, recipe_yield string, recipe_category string, cook_time string, prep_time string, total_time string, date_published string, date_modified string, ts_millis long",
    "recipe_nlg": "id* long!, title string!, ingredients string!, directions string!, link string, source string, ner string!",
    "food_density": "id* long!, food_group string, food_name string!, density_g_per_ml string!, specific_gravity string, biblio_id string, updated_version_2 boolean!",
}

# Tables of numbers and codes: no line break stands inside quotes, so their files can be split. Any other file is read by one task.
WHOLE_LINES = frozenset(
    "food_nutrient food_component food_portion sub_sample_result sub_sample_food sample_food sr_legacy_food survey_fndds_food lab_method_code lab_method_nutrient microbe fndds_ingredient_nutrient_value".split()
)

DATABASES = {"recipe": ("open_recipe", "recipe_nlg"), "conversions": ("food_density",)}
DATABASES["usda"] = tuple(t for t in TABLES if t not in ("open_recipe", "recipe_nlg", "food_density"))


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    required: tuple[str, ...]

    def columns(self, names: list[str] | None = None) -> T.StructType:
        """The whole schema, or the named columns in the given order."""
        return T.StructType([self.schema[n] for n in names]) if names else self.schema


def table_of(name: str) -> Table:
    fields, key, required = [], [], []
    for part in TABLES[name].split(", "):
        column, kind = part.split(" ")
        if column.endswith("*"):
            column = column[:-1]
            key.append(column)
        if kind.endswith("!"):
            required.append(column)
        fields.append(T.StructField(column, TYPES[kind.rstrip("!")], True))
    return Table(name, T.StructType(fields), tuple(key), tuple(required))
