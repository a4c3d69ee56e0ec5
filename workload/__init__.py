"""The operators run on the driver tables, with the same inputs derived in SQL for comparison."""
