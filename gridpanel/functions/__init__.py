"""Column expressions: scalars, calendar keys and keyed random numbers."""
