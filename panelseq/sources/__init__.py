"""Readers, writers, file manifests and fingerprints."""
