"""Readers and writers of datasets, journals, checksums and report bundles."""
