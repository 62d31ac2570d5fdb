"""plans of the evidence analytics library."""
