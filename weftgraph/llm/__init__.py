"""Training-data operators: each module holds one operator, ``queries`` the registered queries.

Nothing outside this subpackage imports it.
"""
