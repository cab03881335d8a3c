"""Backup, catalog, verification and restore of table sets, as Spark jobs."""

from tablevault.model import BackupRequest, BackupResult
from tablevault.vault import Vault

__all__ = ["BackupRequest", "BackupResult", "Vault"]
