"""Table-to-table operators: parsing, chunking, change detection, versions, search, evaluation and reconciliation."""
