"""Analytics over unspent-transaction-output ledgers as Spark DataFrames."""
