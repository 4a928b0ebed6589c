"""Pure-Python extraction from source text; runs in Arrow workers."""
