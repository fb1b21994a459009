"""Reading and writing documents, spans, items and configurations."""
