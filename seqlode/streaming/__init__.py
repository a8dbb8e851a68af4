"""Scoring of streamed queries against a fixed corpus."""
