"""Plan-level helpers: shared tables, numbering, iteration."""
