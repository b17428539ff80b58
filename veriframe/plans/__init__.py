"""What every family of checks shares: specs, the issue table, running and reporting."""
