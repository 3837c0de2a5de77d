"""Operators that prepare training data: search, mixing, licences, copies, languages, scores, tokens."""
