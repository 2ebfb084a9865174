"""Sources and sinks: binary logs, offset logs, manifests, metrics text, benchmark reports, streams."""
