"""Sources: files, directories and generated tables."""
