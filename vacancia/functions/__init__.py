"""Column builders: text, places, URLs, dates."""
