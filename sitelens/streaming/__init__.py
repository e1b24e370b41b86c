"""Recent windows kept current from a stream."""
