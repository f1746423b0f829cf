"""presswork: Spark-native analytics over large collections of news-like documents."""
