"""Feature sources and cell sinks."""
