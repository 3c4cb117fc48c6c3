"""Training-data operators: quality, extraction, packing, media, archives, licences, secrets, mixing, near-dedup, LM scoring.

Nothing outside this subpackage imports it.
"""
