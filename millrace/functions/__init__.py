"""Column builders: text helpers, parsers and rewards."""
