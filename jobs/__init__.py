"""Jobs that are run from the command line, each with a small config file beside it."""
