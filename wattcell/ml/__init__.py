"""Sleep-probability models on MLlib."""
