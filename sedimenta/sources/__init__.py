"""Runs, snapshots and native files."""
