"""docstrata.functions."""
