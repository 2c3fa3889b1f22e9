"""Whole queries over the test layout: each takes (spark, sf_dir) and gives a DataFrame."""
