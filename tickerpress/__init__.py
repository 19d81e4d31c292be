"""Timestamped news and daily prices as leak-free panels and scored forecasts, on Spark."""
