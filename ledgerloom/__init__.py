"""Expense analytics as Spark jobs: receipts in, totals, flags, prices and scores out."""
