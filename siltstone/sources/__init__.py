"""Readers and writers: Markdown trees, versioned snapshots, site registries."""
