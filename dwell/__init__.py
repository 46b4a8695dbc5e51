"""dwell: time-use analytics (sessions, labels, URL hygiene, calendar reports) on Spark.

Every public function takes and returns DataFrames built from built-in Spark
expressions, so Catalyst plans, prunes and pushes down the whole pipeline.
"""

__version__ = "0.1.0"
