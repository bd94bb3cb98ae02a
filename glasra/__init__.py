"""glasra: corpus preparation, scoring and review for speech-and-text corpora, written for Spark."""
