"""Market-news analytics on Spark: price bars, news text, features, datasets and evaluation as lazy DataFrame plans."""
