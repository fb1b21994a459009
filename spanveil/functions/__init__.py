"""Column-level building blocks: array scans, spans, checks, replacements."""
