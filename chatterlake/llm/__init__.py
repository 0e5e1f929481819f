"""Corpus preparation: language, mixing, token counts, decontamination, dedup, quality, extraction, licences, scoring.

Each module holds one operator with its own general interface; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
