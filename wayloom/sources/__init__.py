"""Readers of feeds, networks and catalogs, and writers of artifacts and results."""
