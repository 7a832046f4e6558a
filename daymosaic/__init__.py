"""daymosaic: entity x day panels, features, diagnostics and forecasts on Spark.

Every operator takes DataFrames and returns DataFrames; nothing is computed
until the caller acts on the result.
"""

__version__ = "0.1.0"
