"""Named tables over DataFrames, and the engine that queries them."""
