"""Training-data operators: packing, quality rules, extraction, deduplication, toxicity, chat, tokens, language.

Nothing else in the library imports this subpackage.
"""
