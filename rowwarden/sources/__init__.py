"""Readers of published files and of the portal, and writers of results."""
