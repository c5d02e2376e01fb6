"""Column functions: geometry, clocks, text formats, order statistics."""
