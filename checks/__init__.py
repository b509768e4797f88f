"""Queries over the shared tables, each with the SQL that states its expected result."""
