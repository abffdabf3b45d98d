"""DataFrame operators over catalogs of malware-detection content."""
