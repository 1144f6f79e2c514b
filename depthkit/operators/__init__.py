"""DataFrame -> DataFrame operators on grouped, depth-ordered series."""
