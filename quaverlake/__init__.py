"""quaverlake: a Spark-native engine for catalogues of recordings and the text about them."""
