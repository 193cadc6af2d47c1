"""Training-data operators: tokenisers, filters, near-duplicate search, language-model scoring, media columns.

Nothing outside this folder imports it; queries and their SQL are in ``queries``.
"""
