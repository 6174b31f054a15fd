"""docstrata: versioned document collections and hybrid search as Spark jobs."""
