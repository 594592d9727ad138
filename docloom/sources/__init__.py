"""Folders, manifests and tables as sources of records."""
