"""Source text in, fact rows out: one pass over each file, without any state between files."""
