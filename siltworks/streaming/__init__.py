"""Structured Streaming: protocol logs and event replay."""
