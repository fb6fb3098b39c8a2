"""Training-data operators: packing, scoring, mixing, screening and near-duplicate search.

Each module holds one operator; ``queries`` registers them.  Nothing outside
this subpackage imports it.
"""
