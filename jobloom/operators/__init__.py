"""DataFrame operators over postings, applications, score events and sources."""
