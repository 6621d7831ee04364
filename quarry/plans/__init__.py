"""Registered end-to-end queries over the driver tables (stand-ins per SURVEY §7)."""
