"""Jobs: each a function of a session and paths, with a command line and a config file beside it."""
