"""Plans that chain operators."""
