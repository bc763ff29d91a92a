"""All queries of the library but for those of llm: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from tidewise.queries import fetching, further, models, more, pages, rules, search, service

ALL = {**search.QUERIES, **service.QUERIES, **pages.QUERIES, **more.QUERIES, **rules.QUERIES, **further.QUERIES, **fetching.QUERIES, **models.QUERIES}
