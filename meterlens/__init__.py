"""meterlens: find and grade anomalies in hourly meter readings with Spark.

Every public function takes and returns ``DataFrame`` objects plus explicit parameters;
there is no module-level configuration.
"""
