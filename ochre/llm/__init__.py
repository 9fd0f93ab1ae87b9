"""Training-data operators.

Operators for preparing text corpora, plus the queries and SQL that register
them.  Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
