"""Layers, marts and registered queries."""
