"""Options of a job, and whole jobs made of several operators."""
