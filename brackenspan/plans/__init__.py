"""Query languages, their compiler and the registered queries."""
