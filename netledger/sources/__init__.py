"""Sources of netledger."""
