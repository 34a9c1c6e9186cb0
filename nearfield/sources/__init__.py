"""Readers, writers and synthetic inputs."""
