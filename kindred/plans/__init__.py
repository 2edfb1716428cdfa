"""The operators bound to the driver's tables, and the same queries as SQL."""
