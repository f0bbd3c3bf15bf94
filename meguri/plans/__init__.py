"""Batch jobs: old snapshot + input -> new snapshot + audit."""
