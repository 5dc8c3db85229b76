"""Operators over document rows, invoices, identities, stock and evaluations."""
