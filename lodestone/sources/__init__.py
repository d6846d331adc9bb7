"""Sources and sinks of canonical documents."""
