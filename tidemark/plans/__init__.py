"""Named queries; importing any of them registers all."""

from tidemark.plans import catalog, files, records, runs, streams  # noqa: F401
