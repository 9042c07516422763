"""SQL text and column functions that the operators share."""
