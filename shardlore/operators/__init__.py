"""operators of the storage-cluster analytics."""
