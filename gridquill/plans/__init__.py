"""Query front-end and the registered queries."""
