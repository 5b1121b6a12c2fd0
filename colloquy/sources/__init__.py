"""Input tables, document readers and sinks."""
