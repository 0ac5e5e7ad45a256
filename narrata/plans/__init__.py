"""Queries; importing this package registers them all."""

from narrata.plans import aggregates, functions, graphs, relational, resolution, spans  # noqa: F401
