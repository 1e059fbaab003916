"""Progress of running matches."""
