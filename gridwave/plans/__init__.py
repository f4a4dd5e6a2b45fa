"""Choice between physical strategies."""
