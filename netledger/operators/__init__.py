"""Relational, temporal, graph and spatial operators of netledger."""
