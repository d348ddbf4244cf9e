"""fernwalk: a Spark-native engine that gathers, ranks and condenses web text."""
