"""A Spark-native engine for agent-session logs and the notes distilled from them."""
