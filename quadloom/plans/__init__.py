"""Query texts: lexer, parser, pattern ordering and the compiler to DataFrame plans."""
