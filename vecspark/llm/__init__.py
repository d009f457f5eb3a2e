"""Training-data operators (quality, de-duplication, extraction, encoding, search).

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
