"""docstrata.operators."""
