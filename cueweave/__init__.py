"""cueweave: caption timelines, terminology linking and text-quality analytics on PySpark."""
