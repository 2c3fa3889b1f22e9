"""granary: food, recipe and unit-density analytics expressed with Spark DataFrames."""

__version__ = "0.1.0"
