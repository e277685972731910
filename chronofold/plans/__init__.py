"""plans of chronofold."""
