"""docstrata.plans."""
