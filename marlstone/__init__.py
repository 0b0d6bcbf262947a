"""Marlstone: DataFrame operators for curating, auditing and scoring generated artifacts."""
