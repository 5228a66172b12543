"""Column functions: text normalisation, urls, patterns and extractors."""
