"""Chase features and the win-probability model."""
