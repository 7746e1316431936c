"""Event streams: windows, joins, consumers, change logs, state and dead letters."""
