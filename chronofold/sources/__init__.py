"""sources of chronofold."""
