"""Column functions: instants from mixed timestamp texts, typed values from free text."""
