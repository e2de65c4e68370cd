"""Operators of a training-data pipeline: line dedup, search, WARC, toxicity, mixing,
embedding and SimHash near-dedup, licence scans, URL filters and packing."""
