"""plans of loomquery."""
