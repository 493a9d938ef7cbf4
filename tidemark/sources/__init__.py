"""Tables, ingest, export and maintenance."""
