"""loomgraph: story-graph and agent-telemetry analytics written for Spark."""
import sys

from pyspark import cloudpickle

# Python functions travel to the executors with their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
