"""streaming of chronofold."""
