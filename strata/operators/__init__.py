"""DataFrame operators: validation, profile, cleaning, folds, preparation, balancing, learners,
evaluation, search and clustering."""
