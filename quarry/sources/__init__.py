"""sources of the evidence analytics library."""
