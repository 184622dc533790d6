"""Keeping the memo and its ledger current from streams of entries, calls and changes."""
