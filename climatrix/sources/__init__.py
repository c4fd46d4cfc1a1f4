"""Readers, request-style selection, sinks and the fixture adapter."""
