"""Operators for preparing training data at scale.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries over the driver tables.  Nothing
outside this subpackage imports it.
"""
