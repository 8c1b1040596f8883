"""Training-data operators: tokenizing, fingerprints, filters, joins and scoring of large document tables."""
