"""tidewatch: quality, features, forecasts and allocation for fleets of time series, on Spark."""
