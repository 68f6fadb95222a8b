"""Binding a contract to a DataFrame, and the plan that parses it."""
