"""Column expressions: folder names, patterns, calendar keys, sizes, thresholds."""
