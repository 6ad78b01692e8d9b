"""Where tables and shared scratch come from."""
