"""Programs: text to syntax tree, checks, rewrites, and DataFrame plans."""
