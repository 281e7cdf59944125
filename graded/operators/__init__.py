"""DataFrame operators: sampling, metrics, joins, windows, encoding, scoring, training."""
