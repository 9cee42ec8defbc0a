"""Reading of relational logs into networks."""
