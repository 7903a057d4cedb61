"""Operators for preparing training corpora: sharding, mixing, archives, language, chat, duplicates, scoring, rules, packing, search."""
