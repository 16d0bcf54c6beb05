"""Registered queries and the SQL that must give the same rows."""
