"""Reports and bulk ledger operations."""
