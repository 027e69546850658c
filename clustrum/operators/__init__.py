"""DataFrame operators: assignment, seeding, K-medoids, refinement, balancing, re-mapping."""
