"""Readers, versioned tables and derived inputs."""
