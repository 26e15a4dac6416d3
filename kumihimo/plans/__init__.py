"""Named queries over the standard tables, each with its SQL oracle where SQL can say it."""
