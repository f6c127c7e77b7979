"""Named queries over the table layout and their SQL counterparts."""
