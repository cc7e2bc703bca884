"""Reading packages: file discovery, parsers, recorded JSON lines, and table adapters."""
