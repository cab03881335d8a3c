"""Restore-chain plans and the registered queries."""
