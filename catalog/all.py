"""Importing this module registers every query."""

import catalog.ingest  # noqa: F401
import catalog.customers  # noqa: F401
import catalog.segments  # noqa: F401
import catalog.dashboards  # noqa: F401
