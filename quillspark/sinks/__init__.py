"""Writers of documents, reports, logs and result stores."""
