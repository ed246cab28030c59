"""functions of the storage-cluster analytics."""
