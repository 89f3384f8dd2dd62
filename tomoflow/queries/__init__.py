"""The library's operators as named queries over the driver's tables.

The cube is the table ``embeddings``: vec_id = angle * 10 + det_y, one line of 64 values.
"""
