"""Column functions and ordered helpers.

``canonical``: canonical JSON and hashes. ``identifiers``: ids, kinds and fixed
texts. ``ordered``: positions, running totals and digests over groups of any
size. ``documents``: digests of records with long lists.
"""
