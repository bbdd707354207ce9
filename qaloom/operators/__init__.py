"""DataFrame operators: numbering, search, ranking and answer scores, inference, reports."""
