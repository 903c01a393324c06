"""Streaming of netledger."""
