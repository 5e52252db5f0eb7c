"""Column expressions: calendar, holidays, seasonal indices, error metrics."""
