"""Training-data operators: text cleaning, near-duplicate search, tokens, packing.

Nothing outside this folder imports it; the replay library works without it.
"""
