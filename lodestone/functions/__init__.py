"""Column expressions: text, versions, weights, signatures, references and code symbols."""
