"""Composite plans: the forecasting run and the reporting queries."""
