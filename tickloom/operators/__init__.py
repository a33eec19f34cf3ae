"""DataFrame-to-DataFrame operators; nothing here triggers a Spark action."""
