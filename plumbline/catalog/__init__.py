from plumbline.catalog import budget, comparison, evaluation, quality, review, routing, scans  # noqa: F401
