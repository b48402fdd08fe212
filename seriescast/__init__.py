"""Feature engineering, modelling, forecasting and diagnostics for large panels of
daily price series, written as Spark DataFrame operators."""
