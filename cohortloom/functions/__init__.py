"""Column expressions with the null rules of panels."""
