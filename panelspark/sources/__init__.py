"""Reading and writing tables, and the two calendar inputs."""
