"""Pipeline stages, ranked sources, modifiers and the query verbs, as DataFrame plans."""
