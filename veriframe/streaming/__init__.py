"""Operators over sequences of snapshots."""
