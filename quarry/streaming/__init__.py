"""streaming of the evidence analytics library."""
