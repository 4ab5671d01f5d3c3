"""Reports: JSON, badges, texts, trends, the threshold gate."""
