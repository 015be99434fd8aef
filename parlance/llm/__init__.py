"""Training-data operators; nothing outside this folder imports it but __spark_entry__.py (guarded) and corpus_pipeline.py."""
