"""operators of loomquery."""
