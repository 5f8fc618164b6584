"""Sales-ledger analytics for many businesses at once, written as PySpark DataFrame transformations."""
