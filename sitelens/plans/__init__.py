"""Requests, windows, calendars and reports: what to compute over which span."""
