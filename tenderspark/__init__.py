"""Tender and bid analytics as Spark DataFrame operators."""
