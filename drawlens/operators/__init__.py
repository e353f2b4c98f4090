"""Operators over draws and hits."""
