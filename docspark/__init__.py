"""docspark: document analytics for privacy-sensitive text, written for Spark DataFrames."""
