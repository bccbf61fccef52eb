"""Sources: page files of desktop databases, read in parallel by page ranges."""
