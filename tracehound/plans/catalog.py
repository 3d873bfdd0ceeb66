"""All catalogue queries with their SQL twins."""

from __future__ import annotations

from tracehound.plans import catalog_entries, catalog_files, catalog_learn, catalog_lines

PARTS = [catalog_entries.R, catalog_lines.R, catalog_files.R, catalog_learn.R]
QUERIES = {name: fn for part in PARTS for name, fn in part.queries.items()}
SQL = {name: sql for part in PARTS for name, sql in part.sql.items()}
