"""Column functions: key modes, codecs and checksums."""
