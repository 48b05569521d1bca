"""Sources and sinks: positioned XML nodes, JSON members, reports."""
