"""Histories that grow while they are analysed."""
