"""Fleet schema drift, governed query and audit analytics on Spark."""
