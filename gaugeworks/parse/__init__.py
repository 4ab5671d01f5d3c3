"""Facts from source text."""
