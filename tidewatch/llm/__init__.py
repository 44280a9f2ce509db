"""Operators for preparing training text at scale: filtering, deduplication, mixing, encoding."""
