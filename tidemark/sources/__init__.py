"""Readers, sinks and the shared work folder."""
