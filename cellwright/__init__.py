"""Spark operators for coded microdata, cell counts, linked panels and panel estimation."""
