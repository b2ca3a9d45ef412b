"""Commands, plans, recipes, expiration and dependencies."""
