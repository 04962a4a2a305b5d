"""Column functions: findings, text similarity, document values, tags and lint."""
