"""Spark-native engine for crawled offer pages: URLs, pages, Turkish text extraction, labels, upserts."""
