"""Derivation of operator inputs from the driver tables, with the queries built on them."""
