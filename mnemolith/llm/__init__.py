"""Operators for preparing training text: filters, deduplication, tokens, language and licences.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``registry`` holds the queries over the given tables and their SQL.
"""
