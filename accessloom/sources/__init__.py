"""Where logs come from and are kept."""
