"""Relational operators: silver rows, scorecards, careers, editions, ratings, identities."""
