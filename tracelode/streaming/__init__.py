"""Evidence that arrives while the engine runs."""
