"""Sidecars that follow an append-only stream of keys."""
