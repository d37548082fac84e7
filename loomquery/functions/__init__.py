"""functions of loomquery."""
