"""DataFrame operators: chunking, embedding, retrieval, generation, evaluation, sampling."""
