"""Column expressions. Every one stays inside Catalyst."""
