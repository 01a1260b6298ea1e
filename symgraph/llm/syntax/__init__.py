"""Table-driven parsers of whole source files, built from the grammars of this package."""
