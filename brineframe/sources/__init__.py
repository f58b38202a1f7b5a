"""Scans, manifests, the partitioned cube and its bookkeeping tables."""
