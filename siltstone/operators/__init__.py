"""DataFrame operators over URL manifests, pages, chunks, vectors and conversations."""
