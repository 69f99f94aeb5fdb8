"""Candidate retrieval, scoring, explanation and checks as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks with their code: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
