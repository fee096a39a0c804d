"""DataFrame operators: statistics, series, messages, sampling, features, models, metrics."""
