"""Readers of landed files and payload tables, sinks, and derived inputs."""
