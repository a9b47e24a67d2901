"""cosmolith: catalogue, tree, grid and profile analytics as DataFrame -> DataFrame transforms on Spark."""
