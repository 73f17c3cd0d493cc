"""Column-to-Column functions. Nothing here triggers a job or uses a UDF."""
