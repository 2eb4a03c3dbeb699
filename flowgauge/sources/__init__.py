"""Readers and writers for telemetry, logs and model files."""
