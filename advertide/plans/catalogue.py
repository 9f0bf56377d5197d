"""Importing this module registers every query."""

from advertide.plans import areas, checks, listings, releases, series, streams, upkeep, words  # noqa: F401
