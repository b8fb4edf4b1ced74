"""Training-data operators: ten corpus jobs over documents, pages and benchmark texts."""
