"""larkspur: analytics over streams of postings, written as Spark DataFrame functions."""
