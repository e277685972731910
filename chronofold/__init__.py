"""chronofold: leak-free, point-in-time analytics over relational tables on Spark."""
