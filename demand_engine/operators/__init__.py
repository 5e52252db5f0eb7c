"""Forecast and data operators (DataFrame -> DataFrame)."""
