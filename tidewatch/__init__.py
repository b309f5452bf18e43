"""Entity-hour panel analytics on Spark."""
