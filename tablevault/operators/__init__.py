"""Backup, delta, restore, integrity, catalog, retention and log operators."""
