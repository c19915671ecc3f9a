"""Column functions: text and path helpers, array arithmetic and numeric formatting."""
