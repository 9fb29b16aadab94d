"""The metrics.  Each takes measures (or a frame made from them) and returns a lazy DataFrame."""
