"""Training-data operators: each module is one operator with its own general interface.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries only if it is there.
"""
