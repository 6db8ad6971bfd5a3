"""Flow-sequence analytics on Spark DataFrames.

Packets become two-way flows, flows become bursts ("clumps"), clumps become sliding windows, and
windows become labelled, split, scored and measured samples.  Every operator takes DataFrames and
returns DataFrames, so each can be used with ``df.transform``.
"""

import sys

from pyspark import cloudpickle

# Python helpers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
