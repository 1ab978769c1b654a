"""PySpark-native engine for market time series, trading-rule research and corpus preparation."""
