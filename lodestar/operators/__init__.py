"""DataFrame-in / DataFrame-out operators of the retrieval pipeline."""
