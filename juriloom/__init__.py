"""Document analytics on Spark: segmentation, retrieval, duplicates, instrument graphs, incremental indexing."""
