"""graphloom: a Spark-native document, entity and link graph engine."""
