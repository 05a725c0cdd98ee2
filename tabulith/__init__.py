"""Table analytics as Spark jobs: cleaning, profiling, KPIs, tests, anomalies, audits, joins."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with their job, wherever it was started
cloudpickle.register_pickle_by_value(sys.modules[__name__])
