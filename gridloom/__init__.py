"""gridloom: grid-shaped data and training-corpus operators as Spark plans."""
