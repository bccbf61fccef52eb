"""Training-data operators: sharding, derivatives, mixing, media, quality, dedup, binary output and packing.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its queries only when it is present.
"""
