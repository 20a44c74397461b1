"""Rally analytics on Spark: ordered play-by-play rows in, predictability tables out."""
