"""operators of chronofold."""
