"""Plan-level helpers shared by operators: table access, shared scratch storage, graph components."""
