"""functions of the evidence analytics library."""
