"""Customer analytics on Spark DataFrames: features, segments, marts, charts, checks, chats."""
