"""Plans of netledger."""
