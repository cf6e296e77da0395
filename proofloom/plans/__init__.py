"""Registered queries (one per operator ID) and their SQL oracles."""
