"""streaming of loomquery."""
