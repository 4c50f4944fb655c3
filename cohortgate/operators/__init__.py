"""DataFrame to DataFrame steps; every one is lazy unless its name starts with ``assert_``."""
