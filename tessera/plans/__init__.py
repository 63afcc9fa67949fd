"""The registered queries over the reference operators, one module per family."""
