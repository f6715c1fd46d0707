"""Sources: transcript shapes and event streams."""
