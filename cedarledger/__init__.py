"""Loan surveillance analytics for commercial mortgage securities, as Spark plans."""
