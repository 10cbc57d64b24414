"""Sources (CSV scan, landed forecast JSON, dimensions, driver fixtures) and sinks."""
