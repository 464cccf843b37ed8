"""Registered queries: what the engine can be asked by name."""
