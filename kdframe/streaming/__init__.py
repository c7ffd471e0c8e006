"""Structured Streaming flows and their batch twins."""
