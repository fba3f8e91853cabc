"""Landed payloads -> rows of openings.  Nothing here fetches; pages and JSON are input columns."""
