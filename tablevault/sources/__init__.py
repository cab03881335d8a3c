"""Readers: table sets, JDBC, stored artifacts, JSON log lines."""
