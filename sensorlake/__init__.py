"""sensorlake: Spark-native ingest, report and quality jobs for sensor reading streams.

Every public function takes and returns a ``DataFrame`` built from built-in column
expressions, so Catalyst plans it, and works unchanged on batch and streaming input
unless its docstring says "batch only".
"""

__version__ = "0.1.0"
