"""Relational operators: path joins, supports, pairs, ranking, metrics."""
