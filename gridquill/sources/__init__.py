"""Readers: tables, samples and payloads."""
