"""Tessera: DataFrame operators for sheets, lineage graphs, job ledgers and status tables."""
