"""Analysis of code-coverage reports on Spark."""
