"""Training-data operators: one module per operator, one for their registered queries."""
