"""Table bindings, readers and writers."""
