"""Training-data operators: packing, dedup, token files, chat, mixing, WARC, scans, filters."""
