"""A Spark engine for collections of board diagrams, game archives and their annotations."""
