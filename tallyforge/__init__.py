"""Event-sourced ledger analytics as PySpark DataFrame operators."""
