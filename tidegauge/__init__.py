"""PySpark engine for market series, news text and their association, and for training-data preparation."""
