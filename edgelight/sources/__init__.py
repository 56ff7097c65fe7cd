"""Where logs and requests come from, and where runs are kept."""
