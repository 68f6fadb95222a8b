"""Authored contracts, compiled without Spark."""
