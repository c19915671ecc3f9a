"""Training-data operators: quality rules, near-dedup, decontamination, language models and more.

Nothing outside this subpackage imports it; the queries and their SQL are in ``queries``.
"""
