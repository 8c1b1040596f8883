"""Analytics over noisy multi-source time series, written as Spark DataFrame jobs."""
