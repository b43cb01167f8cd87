"""Queries: each module registers its own when the registry is imported."""

from quillon.plans import registry  # noqa: F401
