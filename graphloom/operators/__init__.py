"""Graph tables, statistics, candidate filters and joins."""
