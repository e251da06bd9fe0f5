"""Co-occurrence counts kept up to date from streams."""
