"""Checks: functions from fact tables to issues."""
