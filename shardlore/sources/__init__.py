"""sources of the storage-cluster analytics."""
