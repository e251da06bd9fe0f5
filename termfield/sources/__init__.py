"""Readers and writers of co-occurrence data and vectors."""
