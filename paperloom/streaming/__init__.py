"""The same pipeline on streams."""
