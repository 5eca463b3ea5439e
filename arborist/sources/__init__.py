"""Sources and sinks: population files, registries, records, reports."""
