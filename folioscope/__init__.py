"""Encyclopedia dumps as Spark tables: articles, search, link graph, word series, visits."""
