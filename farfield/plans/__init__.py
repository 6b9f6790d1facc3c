"""Sets of queries bound to tables."""
