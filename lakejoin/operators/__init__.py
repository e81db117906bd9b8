"""DataFrame operators: profiles, encoders, similarity joins, rankings,
evaluation, training-set generation, clustering and losses."""
