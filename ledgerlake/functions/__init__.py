"""Column-level building blocks: casting, rules, orderings, keys."""
