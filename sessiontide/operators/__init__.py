"""Relational operators on sessions, facts, intervals and ledgers."""
