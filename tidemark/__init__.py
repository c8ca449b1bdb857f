"""Technical analysis of many market series at once, as Spark DataFrame columns."""
