"""Commands composed of operators, and the registered queries."""
