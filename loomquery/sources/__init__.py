"""sources of loomquery."""
