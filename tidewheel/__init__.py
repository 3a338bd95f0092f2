"""Train, store and serve a Gaussian Naive Bayes model on Spark, match replies
to requests, and keep durable counts, all as DataFrame and Structured Streaming
jobs."""

__version__ = "0.1.0"
