"""Where plays come from: tables, datasets and the dataset store."""
