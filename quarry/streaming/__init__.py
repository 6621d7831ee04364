"""Streaming use of the same operators.

The reference has no streaming code; live ingestion is only mentioned as a wish.
The operators here are ordinary DataFrame functions, so they also apply to a
streaming DataFrame: this module wires the question-log counts to a file stream.
"""
