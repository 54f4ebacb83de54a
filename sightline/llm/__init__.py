"""Training-data operators: media columns, decontamination, token counts, PII, packing,
line dedup, HTML extraction, license scans, SimHash near-dedup and a quality classifier.

Nothing outside this subpackage imports it.
"""
