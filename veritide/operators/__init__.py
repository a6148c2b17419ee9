"""DataFrame operators: chunking, citations, claims, checks, retrieval, storage and page layout."""
