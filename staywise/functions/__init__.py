"""Column expressions, fixed vocabularies and plan-level helpers shared by the operators."""
