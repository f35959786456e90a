"""wavespark: versioned sampled-signal ("trace") analytics as Spark DataFrame operators.

Every public function takes and returns DataFrames; the numeric work runs on
executors and is planned by Catalyst.  See README.md for the module map.
"""

__version__ = "0.1.0"
