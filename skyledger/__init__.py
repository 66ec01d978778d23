"""Forecast and order-book analytics expressed as Spark DataFrame operators."""
