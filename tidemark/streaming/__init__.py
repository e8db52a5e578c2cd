"""The transaction log as a stream: bulk and incremental ingest, tailing, listeners."""
