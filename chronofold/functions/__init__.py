"""functions of chronofold."""
