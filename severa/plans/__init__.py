"""Registered queries: one thin function and, where SQL can say it, one DuckDB statement each."""
