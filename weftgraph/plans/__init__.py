"""Plans over several operators: splits, batches, graph networks, evaluation, training, configuration."""
