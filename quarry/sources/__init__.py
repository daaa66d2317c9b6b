"""Canonical tables from outside formats, and writing and reading them."""
