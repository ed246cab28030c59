"""streaming of the storage-cluster analytics."""
