"""operators of the evidence analytics library."""
