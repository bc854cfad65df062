"""Readers and writers of histories, facts and totals."""
