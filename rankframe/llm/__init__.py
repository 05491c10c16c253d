"""Operators of a training-data pipeline (deduplication, language, scoring, tokens, chat, secrets, mixing, HTML)."""
