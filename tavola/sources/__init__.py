"""Sources and sinks: driver tables, CSV contract checks, listing views, writers."""
