"""Operators for preparing training data: mixing, token counts, media, near-duplicates, quality, toxicity, WARC, licences, packing."""
