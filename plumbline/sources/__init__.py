"""Where datasets, archives, caches and audits are read from."""
