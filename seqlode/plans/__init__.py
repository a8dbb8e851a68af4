"""Whole retrieval systems, parameter sweeps, corpus preparation and the registered queries."""
