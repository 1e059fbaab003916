"""Column functions over mappings."""
