"""Values, identities and field access."""
