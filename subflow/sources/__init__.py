"""Sources: delimited files, JSON lines, stage tables, order tables as deliveries."""
