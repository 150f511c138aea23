"""Patent retrieval and analysis as DataFrame programs."""
