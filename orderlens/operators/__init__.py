"""DataFrame operators: features, inventory, labels, models, evaluation, reports."""
