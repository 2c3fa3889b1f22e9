"""Rows of a printed density table: cells to fields."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[\d.]+(?:-[\d.]+)?$"


def compact_row(cells: list[str | None]) -> list[str]:
    """Cells without breaks and outer blanks; blank ones dropped."""
    plain = [(c or "").replace("\n", " ").strip() for c in cells]
    return [c for c in plain if c]


def parse_data_row(cells: list[str]) -> tuple[str, str, str, str, str] | None:
    """(food_name, density, specific_gravity, biblio_id, updated), or None without a name or a number.

    The first number is the density. Behind it ``x`` marks an update, the first further number is the
    specific gravity, the first other token the source; numbers after both are the gravity again.
    """
    numeric = [bool(re.match(NUMERIC, c)) for c in cells]
    if True not in numeric or not (name := " ".join(cells[: numeric.index(True)]).strip()):
        return None
    first = numeric.index(True)
    rest = [(c, k) for c, k in zip(cells[first + 1 :], numeric[first + 1 :], strict=True) if c != "x"]
    gravity = biblio = ""
    for cell, is_number in rest:
        gravity, biblio = (cell, biblio) if is_number and (not gravity or biblio) else (gravity, biblio or cell)
    return name, cells[first], gravity, biblio, "x" if "x" in cells[first + 1 :] else ""


def parsed_row(cells: Column) -> Column:
    """The same as a column: ``struct<food_name, density, specific_gravity, biblio_id, updated>`` or null."""
    is_number = lambda c: c.rlike(NUMERIC)
    at = F.array_position(F.transform(cells, is_number), True)
    name = F.trim(F.array_join(F.slice(cells, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), " "))
    rest = F.slice(cells, (at + 1).cast("int"), F.size(cells))
    start = F.struct(F.lit("").alias("gravity"), F.lit("").alias("biblio"))

    def step(state: Column, cell: Column) -> Column:
        gravity, biblio = state["gravity"], state["biblio"]
        to_gravity = is_number(cell) & ((gravity == "") | (biblio != ""))
        return (
            F.when(cell == "x", state)
            .when(to_gravity, F.struct(cell.alias("gravity"), biblio.alias("biblio")))
            .otherwise(F.struct(gravity.alias("gravity"), F.when(biblio == "", cell).otherwise(biblio).alias("biblio")))
        )

    found = F.aggregate(rest, start, step)
    row = F.struct(
        name.alias("food_name"), F.element_at(cells, at.cast("int")).alias("density"), found["gravity"].alias("specific_gravity"),
        found["biblio"].alias("biblio_id"), F.when(F.array_contains(rest, "x"), "x").otherwise("").alias("updated"),
    )
    return F.when((at > 0) & (name != ""), row)
