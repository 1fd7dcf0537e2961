"""Readers: given tables, Markdown folders, search packs, legacy exports."""
