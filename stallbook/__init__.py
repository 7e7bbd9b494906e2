"""Merchant catalogue, checkout-decision and audit analytics as Spark jobs."""
