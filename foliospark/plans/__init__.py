"""Named queries over the test tables, composed from the operators."""
