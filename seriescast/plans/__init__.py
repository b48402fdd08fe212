"""Feature recipes, training, search, forecasting and reports built from the operators."""
