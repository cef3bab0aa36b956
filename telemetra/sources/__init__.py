"""Sources: OTLP payload ingest, fixture adapters and Parquet table reads."""
