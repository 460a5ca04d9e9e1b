"""All queries of the grid library, with their SQL counterparts."""

from __future__ import annotations

from lithoframe.plans import QUERIES, SQL, Query, areas, catalogue, connections, files, geometry, grid, lines, pillars, scaling, structure, surfaces, timeseries, wells  # noqa: F401

FLAGSHIP = "grid_transmissibility"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
