"""Landed files and stored tables: reading, cleaning, writing."""
