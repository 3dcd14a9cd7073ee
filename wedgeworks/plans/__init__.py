"""Triangle counting plans."""
