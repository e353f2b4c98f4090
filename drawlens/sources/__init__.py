"""Readers and writers of draw histories."""
