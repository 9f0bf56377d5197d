"""Registered queries: each wires operators to the driver tables and states the SQL it must equal."""
