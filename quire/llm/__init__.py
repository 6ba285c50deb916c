"""Training-data operators: fingerprints, quality, packing, chat, BPE, near and substring duplicates, toxicity, HTML, WARC.

Nothing else in the library imports this subpackage.
"""
