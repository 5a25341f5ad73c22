"""Column functions: text, JSON, rectangles."""
