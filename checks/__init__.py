"""Registered queries over the mapped tables, with equivalent DuckDB SQL."""
