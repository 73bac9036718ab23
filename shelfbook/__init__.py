"""Consignment ledger and sales analytics as set-based Spark jobs."""
