"""DataFrame to DataFrame operators, one module per business step."""
