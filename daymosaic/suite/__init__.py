"""Registered queries on the driver tables, each with its SQL counterpart."""

from daymosaic.suite.base import QUERIES, oracle_sql  # noqa: F401
from daymosaic.suite import (  # noqa: F401  (modules register on import)
    aggregates, api, cleaning, composites, features, joins, live, metrics,
    modelling, quality, sets, sources, spatial, streams, windows)
