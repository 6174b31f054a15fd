"""docstrata.sources."""
