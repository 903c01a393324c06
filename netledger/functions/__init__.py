"""Functions of netledger."""
