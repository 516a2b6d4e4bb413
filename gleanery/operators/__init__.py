"""DataFrame operators: links, documents, coverage, learners, constraints."""
