"""Table discovery, prediction files, report sinks and the sample-data adapter."""
