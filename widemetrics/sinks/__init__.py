"""Where datums go: wide tables, delimited text, OTLP-shaped records."""
