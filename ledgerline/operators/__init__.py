"""Operators over execution logs, document memory, quotas and journals."""
