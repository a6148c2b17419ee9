"""Where documents, drafts and reports come from and go to."""
