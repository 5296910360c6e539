"""Event streams: windows, sessions and deduplication with watermarks."""
