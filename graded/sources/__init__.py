"""Sources and sinks: corpus, splits, run documents, metric lines, run tables."""
