"""Question policy, routing, planning and whole pipelines."""
