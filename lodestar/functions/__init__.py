"""Column-level helpers (tokenisers, string clean-up) and fixed constants."""
