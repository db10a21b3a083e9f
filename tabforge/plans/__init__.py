"""Steps that chain the operators from a configuration."""
