"""The batch flows and the questions asked of their results."""
