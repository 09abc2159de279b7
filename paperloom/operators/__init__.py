"""DataFrame operators: parsing, enrichment, chunking, staging."""
