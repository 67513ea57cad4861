"""DataFrame operators: agreement metrics, co-association, diagnostics, reports."""
