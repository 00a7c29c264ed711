"""Training-data operators: language ID, packing, joins, stores, search, counts, mixing, extraction, chat, dedup.

Nothing outside this folder imports it; the folder can be removed without touching the read-depth engine.
"""
