"""Operations of a training-data pipeline: quality rules, near-duplicate
detection, personal data, decontamination, mixing, language identification,
line and substring deduplication, quality scoring and licence scans.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
