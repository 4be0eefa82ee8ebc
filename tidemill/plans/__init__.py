"""Composed plans and the query catalogue."""

from . import catalog, catalog_dossiers, catalog_more, catalog_notices  # noqa: E402,F401  (the second adds to the first)
