"""Every operator as a query over the given tables."""
from loomgraph.catalog import (behaviour, evaluation, graph, matching, streams,  # noqa: F401
                               telemetry)
from loomgraph.catalog.registry import ORACLES, QUERIES  # noqa: F401
