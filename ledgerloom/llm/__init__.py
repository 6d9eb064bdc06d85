"""Operators for preparing training text at scale: PII, dedup, quality, mixing, sharding and more."""
