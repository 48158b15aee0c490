"""The query languages: from strings to plans."""
