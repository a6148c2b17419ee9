"""Evidence retrieval, citation checking and corpus preparation as DataFrame plans."""
