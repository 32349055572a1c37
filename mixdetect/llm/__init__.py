"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` binds them to the tables, ``oracles`` has the SQL.
"""
