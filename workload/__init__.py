"""The driver tables seen as trips, the registered queries and their SQL oracles."""
