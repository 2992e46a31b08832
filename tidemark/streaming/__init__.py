"""Structured Streaming jobs.

Every job writes each micro-batch under its own batch id, so a batch that runs again
after a lost executor or driver replaces its own output. Checkpoints and outputs live in
the shared folder the session names.
"""
