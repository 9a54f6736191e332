"""Row-level treatments on streams."""
