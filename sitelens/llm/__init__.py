"""Training-data operators: language ID, LM scoring, decontamination, packing, near-dedup,
fingerprints, toxicity, PII surrogates, secret scans, line dedup, WARC archives, vector codes
and conversation repair.

Nothing outside this subpackage imports it.
"""
