"""Where results go: datasets, CSV exports and logs."""
