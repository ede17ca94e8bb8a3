"""Column functions: no actions, no Python workers."""
