"""Query plans: the graph-pattern compiler and the registered queries."""
