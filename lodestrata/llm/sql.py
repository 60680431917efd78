"""SQL for DuckDB that gives the same rows as the queries of this package, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {
    "p3_found": r"""
        SELECT DISTINCT id FROM chunks
        WHERE length(content) > 2048
           OR len(regexp_extract_all(content, '\r\n|\n|\r'))
              + CASE WHEN regexp_matches(content, '[^\n\r]$') THEN 1 ELSE 0 END > 60
    """,
}
