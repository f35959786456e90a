"""Query plans: fixture signal tables and the registered queries."""
