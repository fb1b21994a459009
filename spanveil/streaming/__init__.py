"""The same operators over streams of documents."""
