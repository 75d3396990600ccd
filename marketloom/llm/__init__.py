"""Training-data operators: ten corpus-cleaning steps, each a Spark job over whole tables.

Nothing outside this subpackage imports it.
"""
