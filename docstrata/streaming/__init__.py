"""docstrata.streaming."""
