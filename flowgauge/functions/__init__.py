"""Column expressions and model arithmetic."""
