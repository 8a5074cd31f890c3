"""The upsert as a stream of batches."""
