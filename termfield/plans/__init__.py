"""Plans that make co-occurrence tables from token data."""
