"""Reading projects and stored graphs, and writing them."""
