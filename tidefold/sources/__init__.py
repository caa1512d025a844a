"""What is on disk: the log, the sorted segments and the manifest."""
