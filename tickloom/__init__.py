"""Intraday option trade and quote analytics on Spark."""
