"""Bindings and registered queries."""
