"""Column expressions: text keys, cells, periods, redaction, graded signals, vocabularies."""
