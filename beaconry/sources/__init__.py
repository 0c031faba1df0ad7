"""Readers, parsers, normalisers and writers of telemetry signals."""
