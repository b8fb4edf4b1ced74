"""A Spark-first library that audits large collections of repositories and the service data around them."""
