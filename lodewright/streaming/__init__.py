"""The count analyses over streams of documents."""
