"""Training-data operators: sharding, filtering, de-duplication, tokenisation, packing and search.

Nothing else in the library imports this package; ``__spark_entry__`` adds its queries when it is there.
"""
