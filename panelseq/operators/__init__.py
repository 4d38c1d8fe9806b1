"""Panel operators: contracts, features, updaters, metrics, selection, inference."""
