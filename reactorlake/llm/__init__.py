"""Training-data operators: one module per operator, plus the registered queries."""
