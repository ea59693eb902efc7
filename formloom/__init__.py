"""formloom: document analytics written for Spark's DataFrame and SQL APIs."""
