"""siftline: bilingual retrieval and text analytics as Spark DataFrame plans."""
