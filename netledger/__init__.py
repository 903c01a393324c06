"""netledger: audit how a facility network changes over time and space, on Spark DataFrames."""
