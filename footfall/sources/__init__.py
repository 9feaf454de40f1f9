"""Readers for landed files, the calendar, generated series and fallbacks."""
