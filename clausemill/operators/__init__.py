"""DataFrame operators over documents, pages, chunks, tokens and proposals."""
