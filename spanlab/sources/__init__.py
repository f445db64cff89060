"""Sources and sinks: the annotated corpus built from documents, scans and sinks."""
