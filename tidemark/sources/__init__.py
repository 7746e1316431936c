"""Sources: tables, key-value scans and logs."""
