"""Structured Streaming: the raster library has no streams; its operators are batch operators on bounded grids."""
