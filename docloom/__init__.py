"""docloom: versioned document collections and adaptive queries on Spark."""
