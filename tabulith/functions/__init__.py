"""Column expressions, schema helpers and small numeric helpers shared by the operators."""
