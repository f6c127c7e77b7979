"""Operators for preparing text corpora: near-duplicates, copies, linked groups, tokens, packing, look-alikes.

Nothing outside this folder imports it.
"""
