"""Analysis specs: their grammar and their validation."""
