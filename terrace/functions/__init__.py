"""Column expressions and plan-time name helpers."""
