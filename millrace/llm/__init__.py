"""Operators of a training-data pipeline: quality, secrets, mixing, decontamination, tokens, URLs, licences, language, near copies."""
