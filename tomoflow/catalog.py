"""Every query over the driver's tables by name, and the SQL it is checked against."""

from __future__ import annotations

from tomoflow.queries import control, cube, tables, volumes  # noqa: F401  volumes registers with the cube's

QUERIES = {**cube.QUERIES, **tables.QUERIES, **control.QUERIES}
ORACLES = {**cube.ORACLES, **tables.ORACLES, **control.ORACLES}
FLAGSHIP = "projection_means"
