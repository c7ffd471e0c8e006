"""DataFrame operators: dataset shaping, conversations, tokens, losses, evaluation, reports."""
