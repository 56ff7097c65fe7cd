"""The time series over a stream of logs."""
